"""Random replacements: single cells, and tuples that stay unique."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Secret
from ..functions.prng import Mersenne, cell_seed
from ..functions.scalars import tuple_member
from ..functions.shapes import Shape
from ..sources.tables import durable

MAX_ATTEMPTS = 100


def random_column(run_seed: Secret, label: str, column: str, shape: Shape, value: Column, identity: Column, attempt: Column, fills_nulls: bool) -> Column:
    """A replacement drawn for a cell. The same run, cell and attempt always give the same, however often Spark evaluates it."""

    @F.pandas_udf(T.StringType())
    def draw(values: pd.Series, identities: pd.Series, attempts: pd.Series) -> pd.Series:
        some = values.notna() | fills_nulls
        out = pd.Series([None] * len(values), dtype=object)
        seeds = [cell_seed(run_seed.reveal(), label, column, i, a) for i, a in zip(identities[some], attempts[some])]
        if seeds:
            out[some.to_numpy()] = shape.generate(values[some].fillna("").tolist(), Mersenne(seeds))
        return out

    return draw(value, identity, attempt)


def _tuple_key(columns: Sequence[Column], numeric: Sequence[bool]) -> Column:
    members = [tuple_member(c, n) for c, n in zip(columns, numeric)]
    complete = reduce(Column.__and__, [c.isNotNull() for c in columns])
    return F.when(complete, F.struct(*[m.alias(f"m{i}") for i, m in enumerate(members)]))


def redraw_until_unique(
    rows: DataFrame, originals: DataFrame, constraints: Sequence[Sequence[str]], numeric: Mapping[str, bool], new: Mapping[str, str],
    draw: Callable[[DataFrame], DataFrame], retry: bool = True, max_attempts: int = MAX_ATTEMPTS,
) -> DataFrame:
    """(__row, __attempt, __fails): the attempt of each row at which none of its new tuples is an original or another row's.

    ``rows`` has a number __row; ``draw`` adds the new columns for a column __attempt; ``new`` names the new column of each
    rewritten one. Of rows that draw one tuple at once the first has it. Tuples with a null are exempt.
    """
    taken: dict[int, DataFrame] = {}
    for i, c in enumerate(constraints):
        key = _tuple_key([F.col(x) for x in c], [numeric[x] for x in c])
        taken[i] = originals.select(key.alias("k")).where("k is not null").distinct()
    pending = rows.withColumn("__attempt", F.lit(0))
    done: DataFrame | None = None
    for attempt in range(max_attempts):
        drawn = draw(pending)
        keys = [_tuple_key([F.col(new.get(x, x)) for x in c], [numeric[x] for x in c]).alias(f"__k{i}") for i, c in enumerate(constraints)]
        drawn = durable(drawn.select("*", *keys))
        bad = None
        for i in range(len(constraints)):
            key = F.col(f"__k{i}")
            first = drawn.where(key.isNotNull()).groupBy(key).agg(F.min("__row").alias("__first"))
            late = drawn.join(first, f"__k{i}").where(F.col("__row") != F.col("__first")).select("__row")
            clash = drawn.where(key.isNotNull()).join(taken[i].select(F.col("k").alias(f"__k{i}")), f"__k{i}", "left_semi").select("__row")
            both = late.unionByName(clash)
            bad = both if bad is None else bad.unionByName(both)
        bad = durable(bad.distinct())
        good = drawn.join(bad, "__row", "left_anti")
        for i in range(len(constraints)):
            # what this attempt takes is in files already: nothing that was taken before is written again
            taken[i] = taken[i].unionByName(good.select(F.col(f"__k{i}").alias("k")).where("k is not null"))
        result = good.select("__row", F.lit(attempt).alias("__attempt"), F.lit(False).alias("__fails"))
        done = result if done is None else done.unionByName(result)
        left = bad
        if left.limit(1).isEmpty():
            return done
        if not retry or attempt == max_attempts - 1:
            return done.unionByName(left.select("__row", F.lit(0).alias("__attempt"), F.lit(True).alias("__fails")))
        pending = rows.join(left, "__row", "left_semi").withColumn("__attempt", F.lit(attempt + 1))
    raise AssertionError("max_attempts is at least 1")
