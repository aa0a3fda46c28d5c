"""Each operator against a brute-force version, and its defined cases: nulls, empty and long texts, ties, repeats, clashing names."""

import hashlib
import math
import os
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import bpe, exactdedup, htmltext, lm, mixing, repeats, simhash, topk, toxicity, urlfilter
from palimpsest.llm.queries import URL_RULES

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, extra=None):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for name in extra or ():
        df = df.withColumn(name, F.lit("clash"))
    return df


def prose(rng, n, words=None):
    words = words or ["the", "of", "and", "Tree", "river", "stone", "é", "日本", "x1", "don't"]
    return " ".join(rng.choice(words) for _ in range(n))


# -- SimHash ---------------------------------------------------------------------------------------------------------------


def naive_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def naive_components(fps, reach):
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= reach and root[j] < root[i]:
                    root[i], changed = root[j], True
    return root


@pytest.mark.parametrize("shard_rows", [8, 10_000])
def test_simhash_equals_brute_force(spark, shard_rows):
    rng = random.Random(3)
    base = [prose(rng, 60) for _ in range(25)]
    texts = [None, "", " \t\n", "One two", "one TWO", *base]
    texts += [b.replace("river", "lake", 1) for b in base] + base[:5] + ["word " * 400]
    docs = docs_of(spark, texts, extra=["fp", "component_id"])
    got = {r["doc_id"]: r for r in simhash.near_dedup(docs, shard_rows=shard_rows).collect()}
    fps = [naive_fingerprint(t) for t in texts]
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i]["component_id"] for i in range(len(texts))] == naive_components(fps, 4)


def test_vantage_point_search_finds_every_link():
    rng = np.random.default_rng(1)
    points = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    near = points[:400] ^ (np.uint64(1) << rng.integers(0, 63, 400).astype(np.uint64)) ^ np.uint64(5)
    points = np.unique(np.concatenate([points, near]))
    tree = simhash.plan_tree(points[:500], 4)
    idx, shard, home = simhash.route(tree, points, 4)
    assert np.array_equal(np.sort(idx[home]), np.arange(len(points)))
    visits = {}
    for i, s in zip(idx.tolist(), shard.tolist()):
        visits.setdefault(i, set()).add(s)
    own = dict(zip(idx[home].tolist(), shard[home].tolist()))
    a, b = np.nonzero(np.triu(np.bitwise_count(points[:, None] ^ points[None, :]) <= 4, 1))
    assert len(a) > 300 and all(own[j] in visits[i] and own[i] in visits[j] for i, j in zip(a.tolist(), b.tolist()))


def test_sizes_bound_the_search_and_lose_no_link(monkeypatch):
    """At 16 bits distances exclude next to nothing; sizes do, and every pair that they and the bits allow is still found."""
    rng = np.random.default_rng(4)
    points = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    points[2000:] = points[:1000] ^ (np.uint64(7) << rng.integers(0, 60, 1000).astype(np.uint64))
    sizes = np.exp(rng.uniform(0, 7, 3000)).astype(np.int64)
    sizes[2000:] = np.maximum(0, sizes[:1000] * rng.uniform(0.7, 1.3, 1000)).astype(np.int64)
    sizes[:20] = sizes[2000:2020] = 0
    able = np.minimum(sizes[:, None], sizes) >= 0.8 * np.maximum(sizes[:, None], sizes)
    a, b = np.nonzero(np.triu(able & (np.bitwise_count(points[:, None] ^ points) <= 16), 1))
    assert 300 < len(a) and (sizes[a] == 0).any() and (np.minimum(sizes[a], sizes[b]) < np.maximum(sizes[a], sizes[b])).any()
    tree = simhash.plan_tree(points[::5], 4, reach=16, sizes=sizes[::5], least=0.8)
    idx, shard, home = simhash.route(tree, points, 16, sizes, 0.8)
    assert np.array_equal(np.sort(idx[home]), np.arange(3000)) and len(np.unique(shard)) == 16
    assert len(idx) < 6 * 3000  # of 16 shards; by distances alone each fingerprint visits nearly all
    visits, own = set(zip(idx.tolist(), shard.tolist())), dict(zip(idx[home].tolist(), shard[home].tolist()))
    assert all((i, own[j]) in visits and (j, own[i]) in visits for i, j in zip(a.tolist(), b.tolist()))
    monkeypatch.setattr(simhash, "TILE", 64)
    monkeypatch.setattr(simhash, "HELD_LINKS", 10)
    compared, near_pairs = [], simhash.near_pairs
    monkeypatch.setattr(simhash, "near_pairs", lambda rows, columns, reach: compared.append(len(rows) * len(columns)) or near_pairs(rows, columns, reach))
    _, x, y = simhash.link_within(points, points[:0], 16, sizes=sizes, least=0.8)
    want, got = simhash.Linked(3000), simhash.Linked(3000)
    want.add(a, b)
    got.add(x, y)
    assert np.array_equal(got.label, want.label)
    assert sum(compared) < 0.35 * 3000**2


def test_strips_find_every_pair(monkeypatch):
    monkeypatch.setattr(simhash, "STRIP", (3, 7))
    rows, columns = (np.random.default_rng(i).integers(0, 256, n, dtype=np.uint64) for i, n in ((1, 10), (2, 30)))
    got = [(int(i), int(j)) for a, b in simhash.near_pairs(rows, columns, 2) for i, j in zip(a, b)]
    i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ columns) <= 2)
    assert len(got) == len(set(got)) == len(i) > 20 and set(got) == set(zip(i.tolist(), j.tolist()))


def test_trees_carry_components_with_few_edges():
    linked = simhash.Linked(1000)
    linked.add(np.arange(0, 998), np.arange(2, 1000))
    a, b = linked.tree_edges()
    assert len(a) == 998 and max(Counter([*a.tolist(), *b.tolist()]).values()) <= simhash.FANOUT + 1
    again = simhash.Linked(1000)
    again.add(a, b)
    assert np.array_equal(again.label, np.arange(1000) % 2)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["root"] for r in simhash.components(edges).collect()} == {i: 0 for i in range(61)} | {100: 100, 101: 100}


# -- top k -----------------------------------------------------------------------------------------------------------------


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 16]) for i in range(150)]
    vectors[7], vectors[8], vectors[9], vectors[20] = (7, None), (8, [0.0, None, 0.0, 0.0, 0.0, 0.0]), (9, [float("nan")] + [0.0] * 5), (20, [0.0] * 6)
    df = spark.createDataFrame(vectors + [vectors[3]], "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    able = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors + [vectors[3]] if v and all(x is not None and math.isfinite(x) for x in v)]
    want = {}
    for q, v in able:
        if q % 20 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in able if i != q))[:20]
            want[q] = [(i, -s) for s, i in scored]
    for blocks in (dict(vector_block=40, query_block=3), {}):
        got = {}
        for r in topk.top_k(df, **blocks).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert got == want


def test_threshold_search_stops_early_and_keeps_large_numbers_exact():
    rng = np.random.default_rng(0)
    v = rng.integers(-9, 9, (500, 3)).astype(float)
    q = np.array([40.0, 1.0, 0.0])
    ids, scores = topk.threshold_search(v, np.arange(500), topk.sorted_lists(v), q, 5)
    order = np.lexsort((np.arange(500), -(v @ q)))[:5]
    assert np.array_equal(ids, order) and np.array_equal(scores, (v @ q)[order])


def test_queries_of_a_block_read_the_lists_together(monkeypatch):
    """Equal to brute force with ties, own ids and repeated ids; scoring 400 queries against 6,000 rows takes far less time than one query after another."""
    rng = np.random.default_rng(5)
    v = rng.integers(-20, 21, (6000, 24)).astype(float)
    ids = np.sort(rng.integers(0, 5000, 6000))
    q = np.concatenate([v[::15], np.zeros((1, 24)), v[:1] * 2.0**20])
    q_ids = np.concatenate([ids[::15], [-1, int(ids[0])]])
    lists = topk.sorted_lists(v)
    began = time.process_time()
    owner, near, scores = topk.threshold_searches(v, ids, lists, q, q_ids, 20)
    together = time.process_time() - began
    began = time.process_time()
    alone = [topk.threshold_search(v, ids, lists, q[i], 20, int(q_ids[i])) for i in range(len(q))]
    assert together < 0.5 * (time.process_time() - began)
    for rows in (20, 4096):
        monkeypatch.setattr(topk, "SCORED_ROWS", rows)
        owner, near, scores = topk.threshold_searches(v, ids, lists, q, q_ids, 20)
        for i in range(len(q)):
            order = np.lexsort((ids, -(v @ q[i])))
            order = order[ids[order] != q_ids[i]][:20]
            assert np.array_equal(near[owner == i], ids[order]) and np.array_equal(scores[owner == i], (v @ q[i])[order])
            assert np.array_equal(near[owner == i], alone[i][0])


def test_top_k_of_large_numbers_and_repeated_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "WAVE", 2)
    rows = [(0, [1e308, 0.0]), (20, [1e15, 1.0]), (21, [1e15, 2.0]), (22, [-1e15, 0.0]), (40, [2.0, 0.0]), (40, [1.0, 0.0]), (41, [1e300, 0.0])] + [(100 + 20 * i, [0.0, 0.0]) for i in range(9)]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2, query_block=2, vector_block=3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert 0 not in got and got[40] == [(41, topk.MOST), (20, 64 * 64 * 10**15)] and got[20] == [(21, topk.MOST), (41, topk.MOST)] and len(got) == 11


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# -- URL filter ------------------------------------------------------------------------------------------------------------


def naive_verdict(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.action if best else "allow"


@pytest.mark.parametrize("table_rules", [2, 2_000])
def test_url_filter_equals_the_definition(spark, monkeypatch, table_rules):
    monkeypatch.setattr(urlfilter, "TABLE_RULES", table_rules)
    urls = [None, "", "nothing", "http://", "https://Example.ORG/es/x", "https://a.example.org/en/1?x", "https://a.example.org/en/2#/es/", "https://example.org", "https://xexample.org/es/",
            "http://a.com/fr/1", "http://a.com/de/1", "http://com/de/", "http://.org/", "http://a.com/DE/", "ftp://b.org?x=/", "http://É.org/é\n/", "a://b://c.org/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, None)], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = urlfilter.filter_urls(pages, URL_RULES).collect()
    assert len(got) == len(urls) + 1
    assert all((r["host"], r["path"], r["rule"], r["verdict"]) == naive_verdict(urls[r["page_id"]]) for r in got)


def test_url_rules_without_tokens_and_with_wildcards(spark):
    pages = spark.createDataFrame([(1, "http://a.b/x/7/end"), (2, "http://a.b/x/7/stop")], "page_id long, url string")
    rules = [urlfilter.Rule("block", "", "/x/*/end"), urlfilter.Rule("block", "b", "/x/*/stop")]
    out = {r["page_id"]: r["verdict"] for r in urlfilter.filter_urls(pages, rules, default="none").collect()}
    assert out == {1: "none", 2: "block"}
    assert {r["verdict"] for r in urlfilter.filter_urls(pages, []).collect()} == {"allow"}
    assert urlfilter.filter_urls(pages.limit(0), rules).count() == 0


# -- mixing ----------------------------------------------------------------------------------------------------------------


def naive_count(seed, doc_id, mean):
    u = int(hashlib.md5(f"{seed}:{doc_id}:1".encode()).hexdigest()[:13], 16) / (1 << 52)
    p = total = math.exp(-mean)
    k = 0
    while total <= u:
        k += 1
        p *= mean / k
        total += p
    return k


def test_mixing_equals_the_inverse_distribution(spark):
    docs = docs_of(spark, [f"t{i}" for i in range(400)], extra=["copy"])
    n = Counter(r["source"] for r in docs.collect())
    got = Counter(r["doc_id"] for r in mixing.mix_sources(docs, seed=5).collect())
    want = {r["doc_id"]: naive_count(5, r["doc_id"], 400 / len(n) / n[r["source"]]) for r in docs.collect()}
    assert got == {k: v for k, v in want.items() if v}
    rows = mixing.mix_sources(docs, {"s0": 3.0, "s1": 1.0}, seed=5, size=4.0).groupBy("source").count().collect()
    share = {r["source"]: r["count"] for r in rows}
    assert set(share) == {"s0", "s1"} and abs(share["s0"] / 1200 - 1) < 0.15
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    big = mixing.mix_sources(docs.where("doc_id < 3"), seed=1, size=2000.0).count()
    assert abs(big / 6000 - 1) < 0.1  # means beyond one part
    assert mixing.mix_sources(docs, seed=5).columns[-1] == "copy"


# -- exact dedup -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block_bytes", [4, 512])
def test_exact_dedup_equals_grouping(spark, block_bytes, monkeypatch):
    monkeypatch.setattr(exactdedup, "BLOCKS_PER_RANGE", 40)
    monkeypatch.setattr(exactdedup, "PAIRS_PER_RANGE", 20)
    texts = [None, "", "a", "aaaa", "aaaaaaaa", "aaaabaaa", "aaaaaaaa", "a", "é" * 300, "é" * 300, "x" * 2000, "x" * 1999 + "y", "x" * 2000] + ["same text here"] * 40
    docs = docs_of(spark, texts, extra=["name", "kept"])
    got = {r["doc_id"]: r for r in exactdedup.exact_dedup(docs, block_bytes=block_bytes).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    for i, t in enumerate(texts):
        g = groups[t or ""]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (max(g), len(g), i == max(g), hashlib.sha256((t or "").encode()).hexdigest())
    assert exactdedup.keep_distinct(docs).count() == len(groups)


def test_exact_dedup_keeps_different_texts_of_one_hash_apart(spark, monkeypatch):
    """Two hashes for all blocks, so that equal and different ones of a hash lie in many ranges."""
    monkeypatch.setattr(exactdedup, "hash_of", lambda key: F.pmod(F.xxhash64(*key), F.lit(2)))
    monkeypatch.setattr(exactdedup, "BLOCKS_PER_RANGE", 30)
    monkeypatch.setattr(exactdedup, "PAIRS_PER_RANGE", 20)
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 14))) for _ in range(300)]
    got = {r["doc_id"]: r["keep_id"] for r in exactdedup.exact_dedup(docs_of(spark, texts), block_bytes=3).collect()}
    last = {t: i for i, t in enumerate(texts)}
    assert got == {i: last[t] for i, t in enumerate(texts)}


@pytest.mark.parametrize("keep", [exactdedup.keep_distinct, simhash.keep_one])
def test_stages_keep_one_of_repeated_rows_and_null_ids(spark, keep):
    rng = random.Random(12)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(1, a), (1, a), (2, b), (2, b), (2, c), (3, c), (None, d), (None, d), (None, a), (7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = keep(docs)
    assert got.columns == ["doc_id", "text"]
    assert sorted((r["text"] or "", -1 if r["doc_id"] is None else r["doc_id"]) for r in got.collect()) == sorted([(a, 1), (b, 2), (c, 3 if keep is exactdedup.keep_distinct else 2), (d, -1), ("", 7)])


def test_exact_dedup_of_repeated_rows_and_nothing(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    rows = exactdedup.exact_dedup(docs).collect()
    assert sum(r["kept"] for r in rows) == 2 and {r["keep_id"] for r in rows} == {1, None}
    assert exactdedup.exact_dedup(docs.limit(0)).count() == 0


# -- BPE -------------------------------------------------------------------------------------------------------------------

PIECES = ["'s", "'t", "'re", "'ll", "'", " ", "  ", "\n", "\t", "a", "s", "t", "A", "1", "23", "!", "é", "日本", "d", "re", "''", " '", "\x1c", "\x85", "aaaa", "abab", "😀", "٣", "\r\n", "<|endoftext|>", "\xa0", "\0"]


@pytest.fixture(scope="module")
def library():
    with open(VOCABULARY, "rb") as f:
        ranks = bpe.Ranks.cached(f.read())
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})


def test_bpe_equals_the_library(library, monkeypatch):
    ranks, lib = library
    rng = random.Random(9)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + ["", "a" * 3000, "ab" * 2000, " " * 500]
    monkeypatch.setattr(bpe, "PASS_CHARS", 5_000)
    monkeypatch.setattr(bpe, "REPLAY_CHARS", 20_000)
    got = [x.tolist() for flat, counts in bpe.encode_texts(iter(texts), ranks) for x in np.split(flat, np.cumsum(counts)[:-1])]
    assert got == [lib.encode_ordinary(t) for t in texts]


def test_bpe_replay_equals_the_rule_for_odd_vocabularies():
    import base64

    extra = [b"ab", b"bc", b"abc", b"cd", b"bcd", b"aa", b"aaa", b"aab", b"abab", b"bb"]
    rng = random.Random(1)
    for _ in range(30):
        rng.shuffle(extra)
        lines = [base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)] + [base64.b64encode(x) + b" %d" % (256 + i) for i, x in enumerate(extra)]
        ranks = bpe.Ranks(b"\n".join(lines))
        words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))).encode() for _ in range(200)]
        ids, counts = ranks.replay(words)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [ranks.encode_one(w) for w in words]


def test_bpe_round_trip_and_digests(spark, library):
    _, lib = library
    texts = [None, "", "Hello world, it's 2024!", "日本 é\n\n x", "z" * 40_000]
    docs = docs_of(spark, texts, extra=["ids"])
    encoded = bpe.encode(docs, VOCABULARY)
    back = {r["doc_id"]: bytes(r["bytes"]).decode() for r in bpe.decode(encoded, VOCABULARY).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    for r in bpe.digests(docs, VOCABULARY).collect():
        t = texts[r["doc_id"]] or ""
        ids = lib.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert bpe.digests(docs.limit(0), VOCABULARY).count() == 0


def test_distinct_spans_survive_hash_collisions():
    points = np.frombuffer("abcabdabcabd".encode("utf-32-le"), np.uint32)
    starts = np.array([0, 3, 6, 9])
    first, number = bpe.distinct_spans(points, starts)
    assert number[0] == number[2] != number[1] == number[3] and len(first) == 2


# -- toxicity --------------------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        words = prose(rng, 80).split()
        for _ in range(6 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["vilebeast", "nastyfool", "vileworm"])
        texts.append(" ".join(words))
        labels.append((i, 1, int(toxic)))
    texts += [None, "", "   "]
    docs = docs_of(spark, texts, extra=["score", "toxic"])
    table = spark.createDataFrame(labels + [(0, 1, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.score_documents(docs, table).collect()}
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in rows)
    held = [i for i in range(600) if rows[i]["held_out"]]
    assert sum(rows[i]["predicted"] == (i % 3 == 0) for i in held) >= 0.97 * len(held)
    assert rows[600]["predicted"] == rows[601]["predicted"] == 0
    kept = toxicity.keep_ordinary(docs, table)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r["predicted"] for r in rows.values())


def test_toxicity_without_labels(spark):
    docs = docs_of(spark, ["a b", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.score_documents(docs, none).collect()] == [0.0, 0.0]
    assert toxicity.score_documents(docs.limit(0), none).count() == 0


def written_out(words, counts):
    """The recursion for one n-gram at a time: (log P under toxic less that under ordinary) of a word, and the mixture's."""
    k = toxicity.ORDER
    grams = [[Counter() for _ in range(k + 1)] for _ in (0, 1)]  # documents of each class, as the longest n-gram of a place
    pooled, lefts, runs = [Counter() for _ in range(k + 1)], [{} for _ in range(k + 1)], [Counter() for _ in range(k + 1)]
    for w, n in zip(words, counts.T):
        s = f" {w} "
        for i in range(1, len(s)):
            for m in range(1, k + 1):
                if m > i + 1:
                    continue
                g = s[i - m + 1 : i + 1]
                begins = i + 1 == m
                if begins or m == k:
                    for c in (0, 1):
                        grams[c][m][g] += n[c]
                if begins:
                    runs[m][g] += n.sum()
                elif m == k:
                    pooled[m][g] += n.sum()
                else:
                    lefts[m].setdefault(g, set()).add(s[i - m])
    for m in range(1, k + 1):
        for g, found in lefts[m].items():
            pooled[m][g] = len(found)
        if m < k:
            pooled[m].update({g: n - pooled[m][g] for g, n in runs[m].items()})
        else:
            pooled[m].update(runs[m])

    def share(table, g):
        d = toxicity.discounts(np.array([n for n in table.values() if n], float))
        off = {x: min(d[min(int(n), 3)], n) for x, n in table.items() if x[:-1] == g[:-1] and n}
        total = sum(table[x] for x in off)
        return ((table[g] - off.get(g, 0)) / total, sum(off.values()) / total) if total else (0.0, 1.0)

    def shared(g):
        if len(g) == 1:
            return (pooled[1][g] + 0.5) / (sum(pooled[1].values()) + 0.5 * (len(pooled[1]) + 1))
        kept, left = share(pooled[len(g)], g)
        return kept + left * shared(g[1:])

    def ratio(w):
        s, out = f" {w} ", 0.0
        for i in range(1, len(s)):
            g = s[max(0, i - k + 1) : i + 1]
            kept, left = zip(*(share(grams[c][len(g)], g) for c in (0, 1)))
            seen = any(grams[c][len(g)][g] for c in (0, 1))
            low = shared(g) if seen else 1.0
            out += math.log(kept[1] + left[1] * low) - math.log(kept[0] + left[0] * low)
        return out

    return ratio, lambda w: math.log(1 - toxicity.TOXIC_SHARE + toxicity.TOXIC_SHARE * math.exp(ratio(w)))


def test_toxicity_equals_the_recursion_written_out():
    words = ["abab", "abba", "baab", "cab", "bac", "aaaa", "abcabcabc", "b", "abcabd"]
    counts = np.array([[9, 2, 7, 1, 0, 5, 3, 1, 0], [1, 8, 0, 6, 9, 5, 0, 0, 2]], float)
    model = toxicity.train(words, counts)
    _, want = written_out(words, counts)
    asked = [*words, "abx", "zz", "abcabcd", "c", "bacab"]
    assert np.allclose(model.word_scores(asked), [want(w) for w in asked], atol=1e-4)
    model.curve = (-1.0, 2.0)
    texts = ["Abab, cab; cab!", "", "zz " * 50 + "bac_b", " ,.;"]
    for text, got in zip(texts, model.score(texts)):
        own = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        mean = sum(map(want, own)) / len(own) if own else 0.0
        assert abs(got - 1 / (1 + math.exp(1 - 2 * math.asinh(mean / toxicity.BEND)))) < 1e-4


def test_few_toxic_words_among_much_noise(spark):
    """An eighth of the documents is toxic, by one word in forty; all words are made of random syllables, so most are rare."""
    rng = random.Random(17)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"]

    def noise():
        return "".join(rng.choice(syllables) for _ in range(rng.choice([1, 1, 2, 2, 3, 4])))

    marks = ["vermin", "dullard", "wretch", "oafish", "zorg"]
    texts, toxic = [], []
    for i in range(1600):
        words = [noise() for _ in range(rng.randint(40, 400))]
        toxic.append(int(i % 8 == 0))
        for _ in range(max(2, len(words) // 40) if toxic[-1] else 0):
            words[rng.randrange(len(words))] = (lambda m: m if m != "zorg" else m + noise())(rng.choice(marks))
        texts.append(" ".join(words))
    table = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.score_documents(docs_of(spark, texts), table).collect()}
    held = [i for i in rows if rows[i]["held_out"]]
    good, bad = [rows[i]["score"] for i in held if toxic[i]], [rows[i]["score"] for i in held if not toxic[i]]
    assert sum(a > b for a in good for b in bad) >= 0.97 * len(good) * len(bad)
    assert sum(s >= 0.5 for s in good) >= 0.9 * len(good) and sum(s >= 0.5 for s in bad) <= 0.02 * len(bad)


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_toxicity_on_the_supplied_labels(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    if not os.path.isdir(folder):
        pytest.skip("no supplied tables")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.score_documents(spark.read.parquet(f"{folder}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").collect()
    good, bad = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    assert sum(a > b for a in good for b in bad) >= 0.9 * len(good) * len(bad)
    assert 2 * sum(s >= 0.5 for s in good) > len(good) and sum(s >= 0.5 for s in bad) <= 0.03 * len(bad)


# -- HTML ------------------------------------------------------------------------------------------------------------------

LONG = "Some long enough sentence about nothing in particular, with many words. " * 4


def test_article_without_what_stands_beside_it():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><article>x</article>";</script></head><body>
    <header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice"><p>{LONG}</p></div><div class="ad">Buy</div>
    <article><h1>Head &amp; shoulders</h1><p><b>Lead.<br>more<p>{LONG}</p><!-- <p>no</p> --><form><p>{LONG}</p></form><ul><li>one<li>two&nbsp;&#51;</ul><aside>{LONG}</aside>
    <section id="comments"><p>{LONG}</p></section></article><div class="sidebar">{LONG}</div><footer>&copy;</footer></body></html>"""
    body = " ".join(LONG.split())
    assert htmltext.main_text(page) == "\n\n".join(["Head & shoulders", "Lead. more", body, "one", "two 3"])


def test_page_without_an_article_element():
    page = f"<body><div id=top><a href=1>a</a> <a href=2>b</a></div><div id=main><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div class=footer>c</div></body>"
    assert htmltext.main_text(page) == "\n\n".join([" ".join(LONG.split())] * 3)


def test_text_split_over_siblings():
    p, body = f"<p>{LONG}</p>", " ".join(LONG.split())
    page = "<body><div id=wrap>" + f"<section>{p * 10}</section>" * 3 + "</div></body>"
    assert htmltext.main_text(page) == "\n\n".join([body] * 30)
    page = f"<body><div class=page><h1>A headline of some length, as they are</h1><div class=lead>{LONG}</div><div class=text>{p * 20}</div></div></body>"
    assert htmltext.main_text(page) == "\n\n".join(["A headline of some length, as they are", *[body] * 21])
    page = "<body><main>" + f"<article><h2>Part</h2>{p * 3}</article>" * 3 + "</main></body>"
    assert htmltext.main_text(page) == "\n\n".join(["Part", *[body] * 3] * 3)
    assert htmltext.main_text(page.replace("main", "div")) == "\n\n".join(["Part", *[body] * 3] * 3)


def test_layout_wrappers_are_no_asides():
    body = " ".join(LONG.split())
    for word in ("layout has-sidebar", "content no-sidebar", "post no-comments", "with-comments", "sidebar layout", "social"):
        for inner in (f"<article><p>{LONG}</p></article>", f"<h1>{LONG}</h1>", f"<p>{LONG}</p>"):
            assert htmltext.main_text(f"<body><div class='{word}'>{inner}</div></body>") == body
    page = f"<body><div class=text><p>{LONG * 2}</p></div><div class='right sidebar'><p>{LONG}</p></div><div class=casino-ads>{LONG}</div></body>"
    assert htmltext.main_text(page.replace("casino-ads", "casino-ads no-x")) == htmltext.main_text(page) == " ".join((LONG * 2).split())


def test_density_alone_decides():
    """No article, classes that mislead, notices and teasers in ordinary elements; tags and classes say nothing or the wrong thing."""
    body = " ".join(LONG.split())
    p, teaser = f"<p>{LONG}</p>", "<article><p><a href=1>A teaser</a> of a few words</p></article>"
    notice = "<div><p>We keep a few small files on your device.</p><p><a href=x>Fine</a></p></div>"
    links = "<div>" + "<p><a href=1>Another page of this site, with quite a long headline</a></p>" * 12 + "</div>"
    for kind in ("class=sidebar", "class='widget ad'", "", "id=footer"):
        page = f"<body>{notice}{links}<div {kind}>{p * 6}</div><div class='article main content'>{teaser * 5}</div>{notice}</body>"
        assert htmltext.main_text(page) == "\n\n".join([body] * 6)
        assert htmltext.main_text(f"<body><main>{teaser * 4}</main><div {kind}>{p * 6}</div></body>") == "\n\n".join([body] * 6)


def test_densities_equal_the_formula_written_out():
    rng = random.Random(2)

    def element(depth):
        if not depth or rng.random() < 0.2:
            return ["x" * rng.randint(0, 40)]
        return [(rng.choice(["div", "p1", "a", "span"]), element(depth - 1)) for _ in range(rng.randint(1, 4))] + ["y" * rng.randint(0, 30)]

    def source(nodes):
        return "".join(n if isinstance(n, str) else f"<{n[0]}>{source(n[1])}</{n[0]}>" for n in nodes)

    def counted(name, nodes):
        """chars, tags, characters and tags of links, children."""
        inner = [counted(*n) for n in nodes if not isinstance(n, str)]
        chars = sum(len(n) for n in nodes if isinstance(n, str)) + sum(c[0] for c in inner)
        tags = sum(c[1] + 1 for c in inner)
        linked = (chars, tags + 1) if name == "a" else (sum(c[2] for c in inner), sum(c[3] for c in inner))
        return chars, tags, *linked, inner

    def density(c, body):
        if not c[0]:
            return 0.0
        base = math.e + c[0] / max(1, c[0] - c[2]) * c[2] + body * c[0]
        return c[0] / max(1, c[1]) * math.log(1 + c[0] / max(1, c[2]) * max(1, c[1]) / max(1, c[3])) / math.log(1 + math.log(base))

    def walked(c):
        yield c
        for x in c[4]:
            yield from walked(x)

    for _ in range(200):
        nodes = element(4)
        root = htmltext.parse(source(nodes))
        order, top = htmltext.measure(root), counted("body", nodes)
        body = top[2] / max(1, top[0])
        want = [(density(c, body), sum(density(x, body) for x in c[4])) for c in walked(top)]
        assert np.allclose([(x.density, x.total) for x in order], want)
        sums = [w[1] + c[0] - sum(x[0] for x in c[4]) for w, c in zip(want, walked(top))]
        best, found, _ = htmltext.densest(order)
        assert np.allclose([found[id(x)] for x in order], sums)
        if best.parent is None or best is order[int(np.argmax(sums))]:
            continue
        assert order[int(np.argmax(sums))].name not in htmltext.BLOCK  # it climbs out of inline elements alone


def test_the_threshold_and_the_sum_change_what_is_taken(monkeypatch):
    links = "".join(f"<p><a href={i}>one</a></p>" for i in range(400))
    page = f"<body><div>{links}</div><div><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div><div><p>{LONG[:60]}</p><p>y</p></div></body>"
    whole = htmltext.main_text(page)
    assert whole == "\n\n".join(["Head", *[" ".join(LONG.split())] * 2])
    measured = htmltext.measure

    def flat(root):
        order = measured(root)
        for x in order:
            x.total = float(sum(isinstance(n, htmltext.Element) for n in x.nodes))
        return order

    monkeypatch.setattr(htmltext, "measure", flat)  # children counted, not their densities
    assert htmltext.main_text(page) != whole


@pytest.mark.parametrize("piece", ["<a ", '<a "', '<a ="', "<div>", "<p>x", "<li>x<ul>", "<b>", "</div>", "<!--", "<script ", "<", "&", "<td>", "<a href='"])
def test_hostile_pages_take_time_in_proportion(piece):
    began = time.perf_counter()
    htmltext.main_text(piece * (300_000 // len(piece)))
    assert time.perf_counter() - began < 10


def test_broken_tags_leave_no_markup():
    assert htmltext.main_text('<a "' * 3000) == htmltext.main_text("<a " * 5000) == htmltext.main_text("<p>x</p>" + "<a b='c") .replace("x", "") == ""
    assert htmltext.main_text('<p title="a > b" x=">">in</p><p data-id="sidebar" y>2 < 3</p><p/>') == "in\n\n2 < 3"
    assert htmltext.main_text("<!-->a<!--->b<!-- c --!>d</ e>f<?g>h<!doctype i>j") == "abdfhj"


def test_html_cases(spark):
    pages = [(1, "u", None), (2, None, ""), (3, "u", "plain text"), (4, "u", "<p>a<p>b</p>"), (5, "u", "<div>" * 3000 + "deep"), (6, "u", "<script>only"), (6, "u", "<p>&lt;x&gt; &bogus; 😀</p>")]
    rows = htmltext.extract(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in rows)
    assert got == [(1, "", 0), (2, "", 0), (3, "plain text", 10), (4, "a\n\nb", 4), (5, "deep", 4), (6, "", 0), (6, "<x> &bogus; 😀", 13)]


# -- repeated passages -----------------------------------------------------------------------------------------------------


def naive_repeats(docs):
    first, out = {}, []
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [False, True])
def test_repeats_equal_brute_force(spark, monkeypatch, hot):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcd é") for _ in range(rng.randint(30, 400))) for _ in range(10)]
    docs = []
    for i in range(120):
        parts = [(lambda s: s[rng.randint(0, len(s) // 2) :])(rng.choice(base)) if rng.random() < 0.7 else "".join(rng.choice("ab") for _ in range(60)) for _ in range(rng.randint(0, 5))]
        docs.append((i, "".join(parts)))
    docs[3], docs[4], docs[90], docs[91] = (3, None), (4, "a" * 500), (90, "a" * 700), (91, "\0" * 60 + "\x7f" * 60)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 9000)
    monkeypatch.setattr(repeats, "CHUNK", 1000)
    monkeypatch.setattr(repeats, "_powers", None)
    if hot:
        monkeypatch.setattr(repeats, "HOT_STRINGS", 2)
        monkeypatch.setattr(repeats, "SAMPLE_SHARE", 1)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("block", F.lit("clash"))
    assert sorted(tuple(r) for r in repeats.digests(df).collect()) == naive_repeats(docs)
    monkeypatch.setattr(repeats, "_powers", None)


def test_minimizers_of_each_length_are_taken_once(monkeypatch):
    rng = random.Random(9)
    texts = [prose(rng, rng.randint(0, 80)).encode() for _ in range(50)]
    taken, minimizers = Counter(), repeats.passage_minimizers
    monkeypatch.setattr(repeats, "passage_minimizers", lambda data, ks: taken.update(ks) or minimizers(data, ks))
    block = repeats.Block(texts, np.arange(50))
    _, _, number, lengths = block.filter_keys(3)
    starts, runs, ids, words, *_ = block.strings(np.ones(len(number), bool), 3)
    assert taken == {repeats.FILTER_K: 1, repeats.K: 1}
    assert lengths.sum() == runs.sum() == sum(max(0, len(t) - repeats.LENGTH + 1) for t in texts)
    assert all(words[i] == block.raw[a : a + n + repeats.LENGTH - 1] for a, n, i in zip(starts, runs, ids))


def test_removed_spans_and_empty_tables(spark):
    shared = "".join(random.Random(1).choice("abcdefgh") for _ in range(80))
    df = spark.createDataFrame([(1, shared), (2, "xx" + shared + "yy"), (2, shared), (None, shared)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, [(s["start"], s["stop"]) for s in r["spans"]]) for r in repeats.spans(df).collect())
    assert got == [(0, [(0, 80)]), (1, []), (2, [(0, 80)]), (2, [(2, 82)])]
    assert repeats.digests(df.limit(0)).count() == 0


def test_merged_transforms_sort_suffixes():
    rng = random.Random(2)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(50, 90))).encode() for _ in range(40)]
    owners = np.arange(100, 140)
    got = repeats.least_owners(words, owners)
    first = {}
    for w, o in zip(words, owners.tolist()):
        for k in range(len(w) - 49):
            first[w[k : k + 50]] = min(first.get(w[k : k + 50], o), o)
    assert got.tolist() == [first[w[k : k + 50]] for w in words for k in range(len(w) - 49)]


# -- language model --------------------------------------------------------------------------------------------------------


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in lm.fresh().items()}
    inputs, targets = (rng.integers(0, 4000, (3, lm.WINDOW)) for _ in range(2))
    inputs[0, :5] = targets[0, :5] = -1
    _, grad = lm.gradients(p, inputs, targets)
    for k in p:
        at = (inputs[1, 3], 2) if k == "embed" else tuple(rng.integers(0, n) for n in p[k].shape)
        old, found = p[k][at], []
        for e in (1e-4, -1e-4):
            p[k][at] = old + e
            found.append(lm.gradients(p, inputs, targets)[0])
        p[k][at] = old
        assert abs((found[0] - found[1]) / 2e-4 - grad[k][at]) < 1e-5, k


def test_scores_equal_one_position_at_a_time():
    """Batched windows against attention written out for each id; every id is scored once."""
    p = lm.fresh(3)
    rng = np.random.default_rng(1)
    counts = np.array([2, 5, 70, 26, 27])
    ids = rng.integers(0, lm.VOCABULARY, counts.sum()).astype(np.int32)
    got, initial = lm.score_ids(p, ids, counts, 35)
    want, want_initial, at = [], [], 0
    for n in counts.tolist():
        doc = ids[at : at + n]
        at += n
        for t in range(1, n):
            start = (t - 1) // lm.STRIDE * lm.STRIDE - (lm.WINDOW - lm.STRIDE)
            seen = np.arange(max(start, 0), t)
            x = p["embed"][doc[seen]] + p["place"][seen - start]
            w = np.exp((x[-1] @ p["query"]) @ (x @ p["key"]).T / np.sqrt(lm.WIDTH))
            h = x[-1] + (w / w.sum()) @ (x @ p["value"]) @ p["out"]
            h = h + np.maximum(h @ p["up"] + p["up_bias"], 0) @ p["down"]
            group, member = divmod(int(doc[t]), lm.GROUP)
            g = np.exp(h @ p["group"] + p["group_bias"])
            m = np.exp((h + p["in_group"][group]) @ p["member"] + p["member_bias"])
            want.append(np.log(g[group] / g.sum() * m[member] / m.sum()))
            want_initial.append(np.log(g[:35].sum() / g.sum()))
    assert np.allclose(got, want, atol=1e-4) and np.allclose(initial, want_initial, atol=1e-4)


def test_words_merged_side_by_side_equal_the_rule():
    with open(VOCABULARY, "rb") as f:
        ranks = bpe.Ranks.cached(f.read(), lm.BEGIN)
    rng = random.Random(8)
    words = [b"", b"a", *(b"a" * n for n in (2, 3, 47, 48, 49, 300)), *(" ééaée".encode()[: rng.randint(1, 9)] * rng.randint(1, 12) for _ in range(100))]
    words += [rng.randbytes(rng.randint(0, 60)) for _ in range(200)] + [b" " + prose(rng, 1).encode() for _ in range(200)]
    ids, sizes = ranks.encode_words(words)
    assert [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])] == [ranks.encode_one(w) for w in words]
    assert [x.tolist() for x in ranks.encode_words([])] == [[], []]


def test_words_are_encoded_once_for_all_chunks_of_a_block(monkeypatch):
    with open(VOCABULARY, "rb") as f:
        ranks = bpe.Ranks.cached(f.read(), lm.BEGIN)
    monkeypatch.setattr(lm, "CHUNK_BYTES", 300)
    taken, joined = [], b"".join
    for name in ("replay", "encode_words"):
        method = getattr(bpe.Ranks, name, None)
        if method:
            monkeypatch.setattr(bpe.Ranks, name, lambda self, words, method=method: taken.append(joined(words)) or method(self, words))
    rng = random.Random(2)
    texts = [prose(rng, 20).encode() for _ in range(40)]
    targets = lm.train(lm.Adam(lm.fresh()), texts, ranks, 2e-3, 64, np.random.default_rng(3))
    assert len(taken) == 1 and taken[0] == joined(b" " + w for w in dict.fromkeys(w for t in texts for w in lm.words_of(t)))
    assert targets == sum(len(lm.sequences([lm.words_of(t)], ranks)[0]) - 1 for t in texts)


def naive_lm(texts, held, n_blocks, ranks):
    """n_known, base and score of each text: one word at a time, from parameters trained block by block in plain loops."""
    split = [(t or "").encode().lower().split() for t in texts]
    counts = Counter(w for i, words in enumerate(split) if not held[i] for w in [*words, None])
    n, v = sum(counts.values()), len(counts)
    params, rounds = lm.fresh(), {}
    for i, t in enumerate(texts):
        block = signed_xxhash64_of_id_and_text(i, t or "") % n_blocks
        rounds.setdefault(-1 if block == 0 else (block - 1) % lm.ROUNDS, {}).setdefault(block, []).append(i)
    for r in sorted(rounds):
        copies = []
        for block, members in sorted(rounds[r].items()):
            adam, rng, weight = lm.Adam(params), np.random.default_rng(3), 0
            own = [(texts[i] or "").encode() for i in sorted(members) if not held[i]]
            for rate, batch in zip(lm.RATES, (16, lm.TRAIN_BATCH)) if r < 0 else [(lm.RATES[-1], lm.TRAIN_BATCH)]:
                if own:
                    inputs, targets = lm.training_windows(own, ranks)
                    order = rng.permutation(len(inputs))
                    for at in np.split(order, range(batch, len(order), batch)):
                        adam.step(inputs[at], targets[at], rate)
                    weight += (targets >= 0).sum()
            if weight:
                copies.append((weight, adam.p))
        if copies:
            params = {k: sum(w * p[k].astype(np.float64) for w, p in copies) / sum(w for w, _ in copies) for k in params}
            params = {k: x.astype(np.float32) for k, x in params.items()}
    out = []
    for words in split:
        ids, n_ids, sizes = lm.sequences([words], ranks)
        spelled = lm.word_logs(*lm.score_ids(params, ids, n_ids, lm.layout(ranks).groups), sizes, np.array([len(sizes)]))
        base = [math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words, None]]
        score = 0.0
        for w, b, log in zip([*words, None], base, spelled.tolist()):
            score += math.log10(lm.BASE_SHARE * 10**b + (1 - lm.BASE_SHARE) * math.exp(log) if n else math.exp(log))
        out.append((sum(counts[w] > 0 for w in [*words, None]), n, sum(base), score))
    return out


def signed_xxhash64_of_id_and_text(doc_id, text):
    first = xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little"), 42)
    value = xxhash.xxh64_intdigest(text.encode(), first)
    return value - (1 << 64) if value >> 63 else value


def test_lm_scores_equal_plain_loops_however_the_input_is_partitioned(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 4000)
    rng = random.Random(6)
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(80)] + [None, "", "  \n", "Unseenword " * 3, prose(rng, 3000)]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    with open(VOCABULARY, "rb") as f:
        ranks = bpe.Ranks.cached(f.read(), lm.BEGIN)
    n_blocks = sum(len((t or "").encode()) for t in texts) // 3000 + 1
    assert n_blocks > lm.ROUNDS + 1
    want = naive_lm(texts, held, n_blocks, ranks)
    docs = docs_of(spark, texts, extra=["score", "words", "block"])
    found = [{r["doc_id"]: r for r in lm.score_documents(d, VOCABULARY).collect()} for d in (docs, docs.repartition(5, "n_chars"))]
    for i, words in enumerate(((t or "").split() for t in texts)):
        r = found[0][i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(words) + 1, want[i][0], want[i][1])
        assert abs(r["base_score"] - want[i][2]) < 1e-6 and abs(r["score"] - want[i][3]) < 1e-4 * abs(want[i][3])
        assert found[1][i] == r


def test_lm_cases(spark):
    docs = docs_of(spark, ["a b", None])
    assert lm.score_documents(docs.limit(0), VOCABULARY).count() == 0
    rows = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one"), (None, None)], "doc_id long, text string")
    got = lm.score_documents(rows, VOCABULARY).collect()
    assert len(got) == 4 and len({r["score"] for r in got if r["doc_id"] == 1}) == 1 and all(math.isfinite(r["score"]) for r in got)
    only_held = spark.createDataFrame([(i, "one two") for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    assert {(r["n_known"], r["train_tokens"]) for r in lm.score_documents(only_held, VOCABULARY).collect()} == {(0, 0)}


def test_repeated_rows_are_scored_alike_wherever_they_lie_in_a_batch(spark):
    rng = random.Random(12)
    texts = [prose(rng, n) for n in (0, 3, 7, 31, 90, 200)]
    rows = [(i, texts[i]) for i in range(6) for _ in range(67)] + [(100 + i, prose(rng, i)) for i in range(40)]
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY).collect()
    assert len(got) == len(rows) and len({(r["doc_id"], r["score"], r["base_score"]) for r in got}) == 46
    assert len({r["train_tokens"] for r in got}) == 1 and got[0]["train_tokens"] == sum(len(t.split()) + 1 for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1)


def test_mixture_sums_to_one_over_its_events():
    """The known words, and one event for all others, of which the attention model spells two."""
    spelled, counts = np.array([0.4, 0.3, 0.2, 0.1]), np.array([5, 3, 0, 0])
    base = (counts + 0.5) / (counts.sum() + 0.5 * 3)
    known = np.exp(lm.word_probabilities(np.log(base), np.log(spelled), True))[:2].sum()
    other = lm.BASE_SHARE * base[2] + (1 - lm.BASE_SHARE) * spelled[2:].sum()
    assert abs(known + other - 1) < 1e-9
    assert (np.exp(lm.word_probabilities(np.log(base), np.log(spelled), True))[2:] <= other).all()
    assert (lm.word_probabilities(np.log(base), np.log(spelled), False) == np.log(spelled)).all()


def test_training_lowers_the_loss():
    with open(VOCABULARY, "rb") as f:
        ranks = bpe.Ranks.cached(f.read(), lm.BEGIN)
    rng = random.Random(7)
    texts = [prose(rng, 200).encode() for _ in range(60)]
    inputs, targets = lm.training_windows(texts, ranks)
    before, adam = lm.gradients(lm.fresh(), inputs, targets)[0], lm.Adam(lm.fresh())
    lm.train(adam, texts, ranks, 5e-3, 32, np.random.default_rng(3))
    assert lm.gradients(adam.p, inputs, targets)[0] < 0.7 * before


def test_held_out_scores_beat_the_base_on_known_words(spark):
    """Texts in two invented languages: a word's base probability knows nothing of its neighbours, the attention model does."""
    rng = random.Random(3)
    kinds = [[f"{a}{b}" for a in first for b in ("an", "el", "or", "ist", "um")] for first in ("bdgkl", "mnprt")]
    texts = [prose(rng, 120, kinds[i % 2]) for i in range(500)]
    rows = [r for r in lm.score_documents(docs_of(spark, texts), VOCABULARY).collect() if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in rows)
    assert all(r["n_known"] == r["n_tokens"] for r in rows)
    assert sum(r["score"] - r["base_score"] for r in rows) / tokens > 0.1
