"""The relational queries of the engine."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidCategoricalColumn
from ..functions.scalars import comparison_key

MAX_CATEGORIES = 1000


def frequency_profile(df: DataFrame, column: str) -> DataFrame:
    """value and n, one row per distinct value; null is one of them."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def bounded_profile(df: DataFrame, column: str, most: int = MAX_CATEGORIES) -> list[tuple[object, int]]:
    """At most ``most`` categories, the most frequent first, or an error."""
    rows = frequency_profile(df, column).limit(most + 1).collect()
    if len(rows) > most:
        raise InvalidCategoricalColumn(f"{column} has over {most} distinct values")
    return sorted(((r["value"], r["n"]) for r in rows), key=lambda x: (-x[1], x[0] is None, str(x[0])))


def duplicated(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def is_unique(df: DataFrame, columns: Sequence[str]) -> bool:
    return duplicated(df, columns).limit(1).isEmpty()


def has_nulls(df: DataFrame, columns: Sequence[str]) -> bool:
    return not df.where(reduce(Column.__or__, [F.col(c).isNull() for c in columns])).limit(1).isEmpty()


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def distinct_tuples(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Tuples without a null member: one with a null is exempt from uniqueness."""
    return df.select(*columns).where(reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])).distinct()


def forbidden_originals(inputs: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Comparison keys of the originals of all unique bindings of a namespace."""
    parts = [df.select(comparison_key(F.col(c)).alias("key")).where("key is not null") for df, c in inputs]
    return reduce(DataFrame.unionByName, parts).distinct()


def keyset_page(df: DataFrame, columns: Sequence[str], after: Sequence[object] | None, size: int, expanded: bool = False) -> DataFrame:
    """The page of ``size`` rows that follows a key, by comparing rows or, ``expanded``, by a chain of alternatives."""
    if after is not None:
        if expanded:
            chain = F.lit(False)
            for i, (c, x) in reversed(list(enumerate(zip(columns, after)))):
                chain = (F.col(c) > F.lit(x)) | ((F.col(c) == F.lit(x)) & chain) if i < len(columns) - 1 else F.col(c) > F.lit(x)
            df = df.where(chain)
        else:
            df = df.where(F.struct(*columns) > F.struct(*[F.lit(x).cast(df.schema[c].dataType).alias(c) for c, x in zip(columns, after)]))
    return df.orderBy(*columns).limit(size)


def chunk_bounds(df: DataFrame, chunk: str, columns: Sequence[str]) -> DataFrame:
    key = F.struct(*columns)
    return df.groupBy(chunk).agg(F.count(F.lit(1)).alias("n_rows"), F.min(key).alias("first"), F.max(key).alias("last"))


def running_rows(bounds: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """Rows done after each chunk; one row per chunk comes in."""
    return bounds.withColumn("done", F.sum("n_rows").over(Window.orderBy(chunk).rowsBetween(Window.unboundedPreceding, 0)))


def changed_counts(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows in which a new value differs from the old, by column."""
    return df.agg(*[F.count_if(~F.col(new).eqNullSafe(F.col(old))).alias(old) for old, new in pairs])


def orphans(child: DataFrame, child_columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]) -> DataFrame:
    """Child rows whose reference is complete and has no parent."""
    keys = parent.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(parent_columns)])
    on = reduce(Column.__and__, [F.col(c) == F.col(f"__p{i}") for i, c in enumerate(child_columns)])
    return child.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in child_columns])).join(keys, on, "left_anti")


def fk_closure_violations(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges (child, parent) that touch a member at one end alone."""
    child = members.select(F.col("node").alias("__c"))
    parent = members.select(F.col("node").alias("__p"))
    joined = edges.join(child, F.col("child") == F.col("__c"), "left").join(parent, F.col("parent") == F.col("__p"), "left")
    return joined.where(F.col("__c").isNull() != F.col("__p").isNull()).select("child", "parent")


def weighted_pick(r: Column, profile: Sequence[tuple[object, int]], kind: T.DataType) -> Column:
    """The first category whose running total reaches r, from 1 to the sum of weights; at most ``MAX_CATEGORIES`` literals."""
    running, total = [], 0
    for _, n in profile:
        total += n
        running.append(total)
    values = F.array(*[F.lit(v).cast(kind) for v, _ in profile])
    sums = F.array(*[F.lit(x).cast("bigint") for x in running])
    return F.element_at(values, F.size(F.filter(sums, lambda s: s < r)) + 1)
