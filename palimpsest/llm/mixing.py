"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

A source with weight w and n of N rows is to be repeated N * w / n times on average. Each row inverts the Poisson
distribution of that mean at a uniform number hashed from the seed and its doc_id, is exploded by the count, and all
copies are shuffled globally by a hash. The same input and seed always give the same copies.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Source statistics are broadcast up to this many sources, joined by a shuffle beyond.
MAX_BROADCAST_SOURCES = 10_000
#: Larger means are drawn as a sum of independent parts, so that exp(-mean) doesn't vanish.
MAX_PART = 500.0


def uniform(seed: int, doc_id: Column, part: Column) -> Column:
    """In [0, 1), from 52 bits of md5."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), part.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... up to where the tail is below what 52 bits can hit."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("cdf"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), (s["sum"] + p).alias("sum"), F.concat(s["cdf"], F.array(s["sum"] + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["cdf"])


def mix_sources(
    docs: DataFrame, weights: Mapping[str, float] | None = None, seed: int = 7, size: float = 1.0, id_col: str = "doc_id", source_col: str = "source"
) -> DataFrame:
    """All columns of ``docs`` plus ``copy`` (from 1), one row per copy, in an order shuffled over the whole table.

    ``weights`` maps a source to its relative weight (None: the same for every source; a source it doesn't name, and
    the null source where weights are given, gets 0). ``size`` scales the expected number of rows in relation to the
    input. A null source is a source of its own when weights is None. Rows with the same doc_id draw the same
    count; a null doc_id counts as the text "null". Any column named ``copy`` in the input is replaced. An empty table gives
    an empty table.
    """
    names = [c for c in docs.columns if c != "copy"]
    source = F.col(source_col)
    stats = docs.groupBy(source.alias("__source")).agg(F.count(F.lit(1)).alias("__n"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]) if weights else None
        weight = F.lit(0.0) if table is None else F.coalesce(F.element_at(table, F.coalesce(F.col("__source"), F.lit("\0"))), F.lit(0.0))
    stats = stats.withColumn("__w", weight)
    total = stats.agg(F.count(F.lit(1)).alias("sources"), F.sum("__n").alias("rows"), F.sum("__w").alias("w")).first()
    mean = F.lit(float(total["rows"] or 0) * size) * F.col("__w") / F.lit(float(total["w"] or 1.0)) / F.col("__n")
    stats = stats.withColumn("__mean", mean).withColumn("__parts", F.greatest(F.lit(1), F.ceil(F.col("__mean") / MAX_PART).cast("int")))
    stats = stats.select("__source", "__parts", poisson_cdf(F.col("__mean") / F.col("__parts")).alias("__cdf"))
    if total["sources"] <= MAX_BROADCAST_SOURCES:
        stats = F.broadcast(stats)

    def draw(part: Column) -> Column:
        u = uniform(seed, F.col(id_col), part)
        return F.size(F.filter(F.col("__cdf"), lambda c: c <= u))

    counts = F.aggregate(F.sequence(F.lit(1), F.col("__parts")), F.lit(0), lambda acc, part: acc + draw(part))
    counted = docs.select(*names).join(stats, source.eqNullSafe(F.col("__source"))).select(*names, counts.alias("__count"))
    copies = counted.where("__count > 0").select(*names, F.explode(F.sequence(F.lit(1), F.col("__count"))).alias("copy"))
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("copy"))
    return copies.withColumn("__key", key).repartition("__key").sortWithinPartitions("__key").drop("__key")
