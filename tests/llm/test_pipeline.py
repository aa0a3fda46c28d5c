"""The pipeline against its stages written out by hand."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from palimpsest.llm import bpe, toxicity
from palimpsest.llm.queries import ORACLES, QUERIES
from tests.llm.test_llm_operators import naive_count, prose


def shingles5(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def first_of_each_component(texts, least=0.8):
    """Numbers of the texts that are the first of those that they are linked to, by Jaccard similarities of all pairs."""
    sets = [shingles5(t) for t in texts]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return {i for i in range(len(sets)) if label[i] == i}


def test_pipeline_equals_its_stages(spark, tmp_path):
    rng = random.Random(8)
    texts = [prose(rng, 90) for _ in range(60)]
    texts = [t + " vilebeast nastyfool vilebeast" if i % 6 == 0 else t for i, t in enumerate(texts)]
    texts += texts[1:12] + [t.replace("river", "lake", 1) for t in texts[20:30]] + ["", "  ", None]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], rows[40]]  # repeated rows: one of each stays
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(i % 6 == 0)) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, table = (spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in ("documents", "labels"))
    predicted = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(docs, table).collect()}
    assert sum(predicted.values()) > 0
    kept = {i: t for i, t in enumerate(texts) if not predicted[i]}
    last = {t or "": i for i, t in sorted(kept.items())}
    kept = {i: t for i, t in kept.items() if last[t or ""] == i}
    order = sorted(kept)
    first = first_of_each_component([kept[i] or "" for i in order])
    kept = {i: kept[i] for k, i in enumerate(order) if k in first}
    sources = Counter(i % 2 for i in kept)
    want = Counter()
    with open(public_tokenizers.path(corpus_pipeline.VOCABULARY), "rb") as f:
        lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Ranks.cached(f.read()).ranks, special_tokens={})
    for i, t in kept.items():
        ids = lib.encode_ordinary(t or "")
        row = (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        want[row] += naive_count(corpus_pipeline.MIX_SEED, i, len(kept) / len(sources) / sources[i % 2])
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == Counter({k: n for k, n in want.items() if n})


def test_near_copies_equal_brute_force_jaccard(spark, monkeypatch):
    """Copies with changed words, at similarities around 0.8; the bound is that of brute force over shingle sets, not of fingerprints."""
    monkeypatch.setattr("palimpsest.llm.simhash.CELL", 40)
    rng, texts = random.Random(21), []
    for i in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        copy = list(base)
        for at in rng.sample(range(400), rng.choice([2, 4, 6, 8, 9, 12, 16])):
            copy[at] = f"x{rng.randrange(10**6)}"
        texts += [" ".join(base), " ".join(copy)]
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts += [" ".join([f"v{i}", *base[1:]]) for i in range(150)]  # one group over several cells
    sets = [shingles5(t) for t in texts]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    low = [(i, j) for i, j in near if len(sets[i] & sets[j]) < 0.9 * len(sets[i] | sets[j])]
    assert len(low) >= 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert got == first_of_each_component(texts)


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in ([], [(1, "a b c", "en", None, 5), (2, None, None, None, None)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
            docs = spark.createDataFrame(docs.collect(), schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "mix sources", "byte-level bpe"]
