"""Keyed replacement: pure projections, and one-to-one mappings for unique columns."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Secret
from ..functions.prng import Xoshiro, keyed_seed
from ..functions.scalars import comparison_key
from ..functions.shapes import Shape
from ..sources.tables import durable

MAX_PROBES = 100
#: Candidates that an input looks at in one round.
PROBES_A_ROUND = 8


def candidates(key: Secret, namespace: str, shape: Shape, values: Sequence[str], probes: Sequence[int]) -> list[str]:
    draws = Xoshiro([keyed_seed(key.reveal(), namespace, v, p) for v, p in zip(values, probes)])
    return shape.generate(list(values), draws)


def keyed_column(key: Secret, namespace: str, shape: Shape, canonical: Column, probe: Column | None = None) -> Column:
    """The replacement of a canonical text at a probe (0 if not given); null stays null. A map without a shuffle.

    The key travels in the function, so no plan shows it.
    """

    @F.pandas_udf(T.StringType())
    def replace(values: pd.Series, probes: pd.Series) -> pd.Series:
        some = values.notna()
        out = pd.Series([None] * len(values), dtype=object)
        out[some.to_numpy()] = candidates(key, namespace, shape, values[some].tolist(), probes[some].tolist())
        return out

    return replace(canonical, F.lit(0) if probe is None else probe)


def unique_mapping(
    inputs: DataFrame, forbidden: DataFrame, key: Secret, namespace: str, shape: Shape, max_probes: int = MAX_PROBES
) -> DataFrame:
    """(canonical, output) for ``inputs`` (canonical, rank: any ordered type), output null where the probes ran out.

    The result is that of resolving inputs one by one by rank, each taking its first candidate that is no original in
    ``forbidden`` (key), not its own input and not taken. Here all inputs propose at once; of those that want one output the lowest
    rank holds it, also against a holder of higher rank, who then goes on to its next candidate. Inputs that don't
    collide are done after one round.
    """
    pending = durable(inputs.select("canonical", "rank", F.lit(0).alias("probe")))
    holders: DataFrame | None = None
    lost: DataFrame | None = None
    while not pending.limit(1).isEmpty():
        step = F.explode(F.sequence(F.col("probe"), F.least(F.col("probe") + PROBES_A_ROUND - 1, F.lit(max_probes - 1))))
        tried = pending.where(F.col("probe") < max_probes).select("canonical", "rank", step.alias("probe"))
        tried = tried.withColumn("output", keyed_column(key, namespace, shape, F.col("canonical"), F.col("probe"))).withColumn("cmp", comparison_key(F.col("output")))
        free = tried.where(F.col("cmp") != comparison_key(F.col("canonical"))).join(forbidden.select(F.col("key").alias("cmp")), "cmp", "left_anti")
        if holders is not None:  # what a lower rank holds is lost: holders only ever give way to lower ranks
            better = holders.select(F.col("cmp").alias("__cmp"), F.col("rank").alias("__rank"))
            free = free.join(better, F.col("cmp") == F.col("__cmp"), "left").where(F.col("__rank").isNull() | (F.col("__rank") > F.col("rank")))
        first = free.groupBy("canonical", "rank").agg(F.min(F.struct("probe", "output", "cmp")).alias("b")).select("canonical", "rank", "b.*")
        if holders is not None:
            first = first.unionByName(holders)
        claims = durable(first)
        best = claims.groupBy("cmp").agg(F.min(F.struct("rank", "canonical")).alias("b")).select(F.col("b.canonical").alias("winner"))
        judged = claims.join(best, F.col("canonical") == F.col("winner"), "left")
        judged = judged.select("canonical", "rank", F.when(F.col("winner").isNull(), F.col("probe") + 1).otherwise(F.col("probe")).alias("probe"), "output", "cmp", F.col("winner").isNotNull().alias("held"))
        none = F.lit(None).cast("string")
        blocked = pending.join(claims.select("canonical"), "canonical", "left_anti").select("canonical", "rank", (F.col("probe") + PROBES_A_ROUND).alias("probe"), none.alias("output"), none.alias("cmp"), F.lit(False).alias("held"))
        state = durable(judged.unionByName(blocked))
        holders = state.where("held").select("canonical", "rank", "probe", "output", "cmp")
        spent = state.where(~F.col("held") & (F.col("probe") >= max_probes)).select("canonical")
        lost = spent if lost is None else lost.unionByName(spent)
        pending = state.where(~F.col("held") & (F.col("probe") < max_probes)).select("canonical", "rank", "probe")
    empty = inputs.select("canonical", F.lit(None).cast("string").alias("output")).limit(0)
    out = empty if holders is None else holders.select("canonical", "output")
    return out if lost is None else out.unionByName(lost.select("canonical", F.lit(None).cast("string").alias("output")))
