"""Toxicity by class-conditional Kneser-Ney models.

A word's probability in a class is the product of its characters', each given the (at most five) characters before it in the word. The
counts of a class are continuation counts over documents: in how many distinct documents of the class a word goes on so. They are discounted
(three discounts, from the counts of counts), and what is taken off goes to a distribution that both classes share: a Kneser-Ney model of the
pooled words, whose lower orders count distinct characters to the left. So an expression that is rare in both classes has nearly the same
probability in both, and tells little. A toxic text is an ordinary one in which a small share of the words comes from the toxic class. A document
is judged by the difference of its log-likelihoods under that mixture and under the ordinary class, over all its words, divided
by their number; a logistic curve makes it a score.

The shared distribution cancels out of the difference wherever neither class has seen an n-gram in its context. So what is stored is one
value for each n-gram seen, and one for each context, for words that go on otherwise.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import memory, scratch

ORDER = 6
#: Share of a toxic text's words that the toxic class gives; the others are as in ordinary texts.
TOXIC_SHARE = 0.01
#: Labelled documents that are learned from at most, of each class.
MAX_TOXIC_DOCS = 3_000
MAX_ORDINARY_DOCS = 4_000
#: Parts of the labelled documents: the curve is fitted on scores that models without a document's own part gave it.
PARTS = 4
#: Where the curve bends: differences under this count in proportion, larger ones by their logarithm.
BEND = 0.01
#: Characters of text that a task scores at a time, and rows that it adds to a group at once.
GROUP_CHARS = 1_500_000
SLICE_ROWS = 200
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: A word is a run of letters and digits.
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Spelled:
    """Words laid end to end, each between two spaces. ``place``: of a character in its word, the first space being 0."""

    def __init__(self, words: list[str]) -> None:
        joined = "".join([f" {w} " for w in words])
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        starts = np.cumsum(sizes) - sizes
        self.word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        self.place = (np.arange(len(self.points)) - starts[self.word]).astype(np.int32)

    def keys(self, n: int, at: np.ndarray) -> np.ndarray:
        """64-bit codes of the n characters that end at the given positions."""
        code = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n):
                step = self.points[at - i].astype(np.uint64)
                step += np.uint64(11)
                code ^= step
                code *= MULTIPLIER
                np.right_shift(code, np.uint64(29), out=step)
                code ^= step
        return code

    def longest(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the longest n-gram (up to ``ORDER``) that ends at each position, and of its context."""
        gram, context = np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
        size = np.minimum(self.place[at], ORDER - 1) + 1
        for n in range(2, ORDER + 1):
            of = np.flatnonzero(size == n)
            gram[of], context[of] = self.keys(n, at[of]), self.keys(n - 1, at[of] - 1)
        return gram, context


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table, -1 for those that it lacks."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def bent(x: np.ndarray) -> np.ndarray:
    return np.arcsinh(x / BEND)


@dataclass
class Model:
    """Sorted codes of n-grams and of contexts, each with the difference of logs that it stands for. curve: bias and slope."""

    grams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    gram_values: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    contexts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    context_values: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    curve: tuple[float, float] = (0.0, 1.0)
    constant: float | None = None

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word in a toxic text less that in an ordinary one."""
        spelled = Spelled(words)
        at = np.flatnonzero(spelled.place >= 1)
        gram, context = spelled.longest(at)
        got = find(self.grams, gram)
        value = np.zeros(len(at))
        value[got >= 0] = self.gram_values[got[got >= 0]]
        miss = np.flatnonzero(got < 0)
        known = find(self.contexts, context[miss])
        value[miss[known >= 0]] = self.context_values[known[known >= 0]]
        ratio = np.bincount(spelled.word[at], value, len(words))
        return np.logaddexp(np.log(1 - TOXIC_SHARE), np.log(TOXIC_SHARE) + ratio)

    def means(self, texts: list[str]) -> np.ndarray:
        """Of each text the sum over all its words, divided by their number; zero without a word."""
        known: dict[str, int] = {}
        number = known.setdefault
        found = [np.array([number(w, len(known)) for w in words_of(t)], np.int32) for t in texts]
        if not known:
            return np.zeros(len(texts))
        score = self.word_scores(list(known))
        return np.array([score[x].mean() if len(x) else 0.0 for x in found])

    def score(self, texts: list[str]) -> np.ndarray:
        """Between 0 and 1; a text without words has the score of a difference of zero."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        z = self.curve[0] + self.curve[1] * bent(self.means(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def discounts(count: np.ndarray) -> np.ndarray:
    """What to take off counts of 0, 1, 2 and 3 or more, from the counts of counts (Chen and Goodman); 3/4 of 1 where those say nothing."""
    n = [int((count == k).sum()) for k in range(5)]
    if not n[1] or not n[2]:
        return np.array([0, 0.75, 0.75, 0.75])
    y = n[1] / (n[1] + 2 * n[2])
    raw = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.75 for k in (1, 2, 3)]
    return np.array([0.0, *np.clip(raw, 0.05, [0.95, 1.9, 2.85])])


def discounted(count: np.ndarray, context: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """Share of its context's total that each n-gram keeps, and what each context leaves to the distribution below (1: it was never seen)."""
    off = np.minimum(discounts(count)[np.minimum(count, 3).astype(np.int64)], count)
    total, left = np.bincount(context, count, contexts), np.bincount(context, off, contexts)
    safe = np.maximum(total, 1e-300)
    return (count - off) / safe[context], np.where(total > 0, left / safe, 1.0)


def train(words: list[str], counts: np.ndarray) -> Model:
    """From the number of documents of each class (ordinary, toxic) that hold each word."""
    seen = np.flatnonzero(counts.sum(0) > 0)
    words, counts = [words[i] for i in seen.tolist()], counts[:, seen]
    spelled = Spelled(words)
    shared = np.zeros(len(spelled.points))
    pooled = counts.sum(0)
    tables: list[tuple[np.ndarray, ...]] = []
    for n in range(1, ORDER + 1):
        at = np.flatnonzero(spelled.place >= max(1, n - 1)).astype(np.int32)
        types, first, type_of = np.unique(spelled.keys(n, at), return_index=True, return_inverse=True)
        type_of = type_of.astype(np.int32)
        whole = spelled.place[at] == n - 1  # begins with the word: nothing stands to the left of it
        if n == ORDER:
            count = np.bincount(type_of, pooled[spelled.word[at]], len(types))
        else:
            inner = np.flatnonzero(~whole).astype(np.int32)
            one = np.unique(spelled.keys(n + 1, at[inner]), return_index=True)[1]
            count = np.bincount(type_of[inner[one]], minlength=len(types)).astype(float)
            del inner, one
            begins = np.bincount(type_of[whole], pooled[spelled.word[at[whole]]], len(types))
            count = np.where(begins > 0, begins, count)
        if n == 1:
            shared[at] = ((count + 0.5) / (count.sum() + 0.5 * (len(types) + 1)))[type_of]
            continue
        ctx, ctx_of = np.unique(spelled.keys(n - 1, at[first] - 1), return_inverse=True)
        keeps, leaves = discounted(count, ctx_of, len(ctx))
        shared[at] = keeps[type_of] + leaves[ctx_of][type_of] * shared[at]
        # n-grams of the highest order, and shorter ones that begin a word, are where a class's own counts are asked
        top = np.ones(len(types), bool) if n == ORDER else np.bincount(type_of[whole], minlength=len(types)) > 0
        own = np.flatnonzero(whole | (n == ORDER))
        logs, rest = [], []
        for c in (0, 1):
            k, left = discounted(np.bincount(type_of[own], counts[c][spelled.word[at[own]]], len(types)), ctx_of, len(ctx))
            logs.append(np.log(k + left[ctx_of] * shared[at[first]]))
            rest.append(np.log(left))
        asked = np.unique(ctx_of[top])
        tables.append((types[top], (logs[1] - logs[0])[top], ctx[asked], (rest[1] - rest[0])[asked]))
    if not tables:
        return Model()
    grams, values, contexts, context_values = (np.concatenate([t[i] for t in tables]) for i in range(4))
    by, by_context = np.argsort(grams), np.argsort(contexts)
    return Model(grams[by], values[by].astype(np.float32), contexts[by_context], context_values[by_context].astype(np.float32))


def fit_curve(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic regression on bent means, slightly damped, by Newton's method."""
    x = np.stack([np.ones(len(x)), bent(x)], axis=1)
    w, damp = np.zeros(2), np.diag([1e-3, 1e-2])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + damp, x.T @ (weight * (label - p)) - damp @ w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[int, int], Counter] = {}
    for batch in batches:
        for part, y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            found.setdefault((part, y), Counter()).update(set(words_of(text.as_py())))
    for (part, y), n in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), pa.array([y] * len(n), pa.int32()), pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["part", "y", "word", "n"])


def _train_group(table: pa.Table) -> pa.Table:
    summed = table.group_by("word").aggregate([("a", "sum"), ("b", "sum")])
    model = train(summed.column("word").to_pylist(), np.array([summed.column(c).to_numpy() for c in ("a_sum", "b_sum")], float))
    arrays = (model.grams, model.gram_values, model.contexts, model.context_values)
    del summed
    memory.give_back()
    return pa.table({"model": table.column("model").slice(0, 1), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in zip("ghij", arrays)}})


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label_col: str = "toxic") -> Model:
    """A model from labelled documents outside the held-out fold.

    At most ``MAX_TOXIC_DOCS`` toxic and ``MAX_ORDINARY_DOCS`` ordinary documents are learned from, chosen by a hash of doc_id; of equal texts
    of a class one counts. The curve is fitted on the same documents, each scored by a model of the other parts, and weighted so that the classes
    stand as they do among all labels. A document with several labels is toxic if one of them says so. Without a label of one class every
    score is the other's. All that a task or the driver holds is bounded by the sample.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    known = known.where(fold(F.col("id")) != 0).groupBy("id").agg(F.max("y").alias("y"))
    limits = {0: MAX_ORDINARY_DOCS, 1: MAX_TOXIC_DOCS}
    sizes = {r["y"]: r["count"] for r in known.where("y in (0, 1)").groupBy("y").count().collect()}
    chosen = [r for y, most in limits.items() for r in scratch.bounded_sample(known.where(F.col("y") == y), ["id"], most, 2, sizes.get(y, 0))]
    if len({r["y"] for r in chosen}) < 2:
        return Model(constant=float(chosen[0]["y"]) if chosen else 0.0)
    kind = labels.schema[id_col].dataType.simpleString()
    picked = F.broadcast(spark.createDataFrame([(r["id"], r["y"]) for r in chosen], f"id {kind}, y int"))
    sample = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(picked, "id")
    sample = scratch.write(sample.groupBy("y", "text").agg(F.min("id").alias("id")).select(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(PARTS)).cast("int").alias("part"), "y", "text"), "labelled")
    counts = sample.mapInArrow(_count, "part int, y int, word string, n bigint").groupBy("part", "word")
    counts = counts.agg(*(F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(c) for y, c in ((0, "a"), (1, "b"))))
    without = F.filter(F.sequence(F.lit(0), F.lit(PARTS)), lambda m: m != F.col("part"))  # the last model leaves no part out
    trained = counts.withColumn("model", F.explode(without)).select("model", "word", "a", "b").groupBy("model")
    rows = trained.applyInArrow(_train_group, "model int, g binary, h binary, i binary, j binary").collect()
    models = {r["model"]: Model(np.frombuffer(r["g"], np.uint64), np.frombuffer(r["h"], np.float32), np.frombuffer(r["i"], np.uint64), np.frombuffer(r["j"], np.float32)) for r in rows}
    final = models.pop(PARTS, Model())
    shipped = spark.sparkContext.broadcast(models)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, texts = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            x = np.zeros(batch.num_rows)
            for p in np.unique(part).tolist():
                at = np.flatnonzero(part == p)
                x[at] = shipped.value.get(p, Model()).means([texts[i] for i in at.tolist()])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x)], names=["y", "x"])
        memory.give_back()

    rated = sample.mapInArrow(rate, "y int, x double").toArrow()
    shipped.unpersist()
    y = rated.column("y").to_numpy()
    n = np.bincount(y, minlength=2)
    if not n.all():
        return Model(constant=float(n[1] > 0))
    weight = np.array([sizes[0], sizes[1]]) / n
    final.curve = fit_curve(rated.column("x").to_numpy(), y, (weight * n.sum() / (weight * n).sum())[y])
    return final


def scored(docs: DataFrame, model: Model, text: str, out, schema: str) -> DataFrame:
    """``out(batch, scores)`` for runs of batches; texts are scored in groups of bounded size."""
    shipped, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, chars = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            scores = shipped.value.score(texts)
            begin = 0
            for batch in held:
                yield out(batch, scores[begin : begin + batch.num_rows])
                begin += batch.num_rows
            held.clear()
            texts.clear()

        for whole in batches:
            for begin in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(begin, SLICE_ROWS)
                held.append(batch)
                more = [x or "" for x in batch.column(at).to_pylist()]
                texts.extend(more)
                chars += sum(map(len, more))
                if chars >= GROUP_CHARS:
                    yield from flush()
                    chars = 0
        if held:
            yield from flush()
        memory.give_back()

    return docs.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted, one row per document.

    A null text counts as empty; an empty one has the score of a difference of zero. A null doc_id is of the fold
    of the empty text. Labels, language, source and doc_id are no inputs of a score. Repeated rows are scored alike; other
    columns play no part. An empty table gives an empty table.
    """
    model = learn(docs, labels, text, id_col)
    source = docs.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col)) == 0).alias("held_out"), F.col(text).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def out(batch: pa.RecordBatch, scores: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return scored(source, model, "text", out, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_ordinary(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that aren't predicted to be toxic, all columns unchanged."""
    model = learn(docs, labels, text, id_col)
    return scored(docs, model, text, lambda batch, scores: batch.filter(pa.array(scores < 0.5)), docs.schema)
