"""Reading tables, and replacing them as whole snapshots."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidConfiguration


def read(spark: SparkSession, location: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A table by path, or by name if the format is ``table``. No row is ever filtered out."""
    return spark.table(location) if fmt == "table" else spark.read.format(fmt).options(**options).load(location)


def replace_snapshot(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write beside the old files, then swap. A failure leaves the old snapshot as it was."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    mark = uuid.uuid4().hex
    old, staged, kept = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.staged-{mark}", f"{path}.old-{mark}"))
    fs = old.getFileSystem(conf)
    try:
        df.write.format(fmt).save(staged.toString())
    except Exception:
        fs.delete(staged, True)
        raise
    had = fs.exists(old)
    if had:
        fs.rename(old, kept)
    if not fs.rename(staged, old):
        if had:
            fs.rename(kept, old)
        fs.delete(staged, True)
        raise OSError("the staged snapshot could not be moved into place")
    if had:
        fs.delete(kept, True)


_live: list[str] = []
_own: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset: a temporary folder in local mode, on a cluster an error, as executors share none."""
    global _own
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise InvalidConfiguration("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="palimpsest-")
    return _own


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared scratch folder; it lasts until the surrounding :func:`scratch` ends."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/palimpsest-{spark.sparkContext.applicationId}/run-{uuid.uuid4().hex}"
    if not _live:
        atexit.unregister(_sweep)
        atexit.register(_sweep, spark)
    _live.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._palimpsest_path = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes the tables that :func:`durable` wrote within, failure or not, but for paths put on the list it gives."""
    begun, kept = len(_live), []
    try:
        yield kept
    finally:
        mine, _live[begun:] = _live[begun:], []
        for path in mine:
            if path in kept:
                _live.append(path)
            else:
                delete(spark, path)


def _sweep(spark: SparkSession) -> None:
    """What is left when the interpreter ends, the session permitting."""
    if spark.sparkContext._jsc is not None:
        for path in _live:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
