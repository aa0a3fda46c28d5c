"""Stable identities of rows, their order, and chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UnpageableTable
from ..operators import relational
from ..sources.catalog import TableInfo
from ..sources.tables import durable
from .rules import RuleSet, Target

#: Families whose equality and order are the same everywhere.
IDENTITY_FAMILIES = ("string", "integer", "boolean", "datetime")


@dataclass(frozen=True)
class Identity:
    columns: tuple[str, ...]
    source: str


def resolve_identity(df: DataFrame, target: Target, rules: RuleSet, info: TableInfo) -> Identity:
    """Primary key, the model's key, a unique index, the declared key, or all other columns together.

    All but the primary key must be disjoint from rewritten columns, free of nulls and proven unique on the data.
    """
    written, refused = set(rules.fields), []

    def typed(columns: tuple[str, ...]) -> bool:
        bad = [c for c in columns if c not in info.columns or info.columns[c].family not in IDENTITY_FAMILIES]
        refused.extend(bad)
        return not bad

    def proven(columns: tuple[str, ...]) -> bool:
        if not columns or not set(columns) <= set(info.columns) or written & set(columns) or not typed(columns):
            return False
        try:
            return not relational.has_nulls(df, columns) and relational.is_unique(df, columns)
        except PySparkException:  # a probe that fails proves nothing
            return False

    if info.primary_key and not written & set(info.primary_key) and typed(info.primary_key):
        return Identity(info.primary_key, "primary")
    tries = [((target.key_name,), "model-key")] if target.key_name else []
    tries += [(u, "unique") for u in info.constraints()] + [(tuple(rules.paging_key), "declared")]
    for columns, source in tries:
        if proven(columns):
            return Identity(columns, source)
    rest = tuple(c for c, i in info.columns.items() if c not in written and i.family in IDENTITY_FAMILIES and not i.nullable)
    if not rest:  # files mark every column nullable: let the data tell
        rest = tuple(c for c, i in info.columns.items() if c not in written and i.family in IDENTITY_FAMILIES and not relational.has_nulls(df, (c,)))
    if proven(rest):
        return Identity(rest, "fallback")
    if written & {*info.primary_key, target.key_name}:
        raise UnpageableTable(f"{target.label}: the primary key of {target.table} is rewritten and no other identity was found")
    if refused:
        raise UnpageableTable(f"{target.label}: {refused[0]} of {target.table} has a type that can't identify rows")
    raise UnpageableTable(f"{target.label}: {target.table} has no stable identity")


def with_position(df: DataFrame, columns: tuple[str, ...], name: str) -> DataFrame:
    """``df`` with the 0-based place of each row in the order of ``columns``.

    Rows are sorted in ranges, and each range's rows are numbered on from the ranges before it; one number per range goes
    back to the tasks. The sorted rows are written to the scratch folder, so that both uses see the same ranges.
    """
    low = F.lit((1 << 33) - 1)
    ordered = df.repartitionByRange(*[F.col(c) for c in columns]).sortWithinPartitions(*columns)
    ordered = durable(ordered.withColumn("__range", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id().bitwiseAND(low)))
    base, total = [], 0
    for r in ordered.groupBy("__range").count().orderBy("__range").collect():
        base.append((r["__range"], total))
        total += r["count"]
    offsets = F.broadcast(df.sparkSession.createDataFrame(base, "__range int, __base bigint"))
    out = ordered.join(offsets, "__range").withColumn(name, F.col("__base") + F.col("__place")).drop("__range", "__place", "__base")
    out._palimpsest_path = ordered._palimpsest_path
    return out


def chunk_of(position: Column, size: int) -> Column:
    return (F.floor(position / size) + 1).cast("bigint")
