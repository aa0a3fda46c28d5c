"""Tables that cut lineage, kept in the folder every executor shares.

Written Parquet survives lost executors, unlike a local checkpoint, and is smaller than ``checkpoint()`` files.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

_own_root: str | None = None


def root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where that is unset: a temporary folder in local mode, on a cluster an error, as executors share none."""
    global _own_root
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="palimpsest-")
    return _own_root


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{root(spark)}/palimpsest-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    atexit.register(_quiet_drop, spark, path)
    return path


def write(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a written table, read back with the same schema."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._palimpsest_path = path
    return out


def digest(text: str) -> Column:
    """SHA-256 of a text, in hex; a null text counts as empty."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


#: Keys of rows (an id and a digest of 64 characters) that are broadcast, some 60 MB at most; more are joined by a shuffle.
MAX_BROADCAST_KEYS = 500_000


def _checked(keys: DataFrame, n: int) -> DataFrame:
    return F.broadcast(keys) if n <= MAX_BROADCAST_KEYS else keys


def without(docs: DataFrame, gone: DataFrame, repeated: DataFrame, text: str, id_col: str) -> DataFrame:
    """``docs`` without the rows of ``gone``, and with one row alone for each of ``repeated``; both hold id and :func:`digest` of text, as __id and __sha.

    Of repeated rows it doesn't matter which one stays. The table is dealt out once at most, to be held against ``gone``, and not at all
    if its keys can be broadcast; where there are repeated rows, these are set apart first, and only they are dealt out for that.
    """
    named = docs.withColumn("__text_sha", digest(text))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text_sha") == F.col("__sha"))
    gone, repeated = write(gone.select("__id", "__sha"), "gone"), write(repeated.select("__id", "__sha"), "repeated")
    out, once, n = named, None, repeated.count()
    if n:
        keys = _checked(repeated, n)
        out, once = named.join(keys, same, "left_anti"), named.join(keys, same, "left_semi").dropDuplicates([id_col, "__text_sha"])
    out = out.join(_checked(gone, gone.count()), same, "left_anti")
    return (out.unionByName(once) if once is not None else out).drop("__text_sha")


def bounded_sample(df: DataFrame, keys: list[str], most: int, seed: int, count: int | None = None) -> list[Row]:
    """About ``most`` rows by a hash of their keys, never over, the same ones each time. No task returns more than its share."""
    n = df.count() if count is None else count
    span = 1 << 40
    low = min(span, int(span * (1.2 * most + 50) / max(1, n)) + 1)
    place = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(span))
    found = df.withColumn("__place", place).where(F.col("__place") < low).limit(2 * most + 200).collect()
    return sorted(found, key=lambda r: (r["__place"], *(str(r[k]) for k in keys)))[:most]


def drop(df: DataFrame | None) -> None:
    """Delete a table made by :func:`write` that no later plan reads."""
    path = getattr(df, "_palimpsest_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _quiet_drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jvm is None:
        return
    try:
        _delete(spark, path)
    except Exception:  # the gateway may be gone at interpreter exit
        return
