"""What a run did."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITTED, ROLLED_BACK, DRY_RUN = "committed", "rolled_back", "dry_run"
CHUNK_SCHEMA = "target string, chunk bigint, n_rows bigint, first string, last string, status string, error string"


@dataclass(frozen=True)
class ChunkReport:
    chunk: int
    rows: int
    first: dict[str, Any]
    last: dict[str, Any]
    status: str
    error: str | None = None


@dataclass
class TargetReport:
    """``chunk_rows``: a row per attempted chunk (chunk, n_rows, first, last), as there may be too many for the driver."""

    target: str
    table: str
    rows: int = 0
    chunk_size: int = 0
    expected_chunks: int = 0
    attempted: int = 0
    done_rows: int = 0
    status: str = COMMITTED
    failed_chunk: ChunkReport | None = None
    changed: dict[str, int] = field(default_factory=dict)
    skipped: str | None = None
    fk_enforcement: bool = True
    chunk_rows: DataFrame | None = field(default=None, repr=False, compare=False)

    @property
    def failed(self) -> bool:
        return self.failed_chunk is not None

    @property
    def rows_sanitized(self) -> int:
        return self.done_rows if self.status == COMMITTED else 0

    @property
    def chunks_not_attempted(self) -> int:
        return max(0, self.expected_chunks - self.attempted)

    @property
    def chunks(self) -> list[ChunkReport]:
        """All chunks, on the driver: for runs of few."""
        found = [] if self.chunk_rows is None else self.chunk_rows.orderBy("chunk").collect()
        out = [ChunkReport(r["chunk"], r["n_rows"], r["first"].asDict(), r["last"].asDict(), self.status) for r in found]
        return [*out[:-1], self.failed_chunk] if self.failed_chunk else out

    def to_dict(self) -> dict[str, Any]:
        """Without the chunks, but for a failed one; :meth:`RunReport.to_df` has them."""
        own = {f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("chunk_rows", "failed_chunk")}
        return own | {
            "failed_chunk": asdict(self.failed_chunk) if self.failed_chunk else None, "failed": self.failed, "rows_sanitized": self.rows_sanitized, "chunks_not_attempted": self.chunks_not_attempted,
        }


@dataclass
class RunReport:
    dry_run: bool = False
    targets: list[TargetReport] = field(default_factory=list)
    not_attempted: list[str] = field(default_factory=list)

    @property
    def failed(self) -> bool:
        return any(t.failed for t in self.targets)

    @property
    def rows_sanitized(self) -> int:
        return sum(t.rows_sanitized for t in self.targets)

    def to_dict(self) -> dict[str, Any]:
        return {
            "dry_run": self.dry_run, "failed": self.failed, "rows_sanitized": self.rows_sanitized,
            "not_attempted": self.not_attempted, "targets": [t.to_dict() for t in self.targets],
        }

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), default=str)

    def to_df(self, spark: SparkSession) -> DataFrame:
        """One row per chunk."""
        out = spark.createDataFrame([], CHUNK_SCHEMA)
        for t in self.targets:
            if t.chunk_rows is None:
                continue
            bad = F.col("chunk") == (t.failed_chunk.chunk if t.failed_chunk else -1)
            out = out.unionByName(t.chunk_rows.select(
                F.lit(t.target).alias("target"), "chunk", "n_rows", F.to_json("first").alias("first"), F.to_json("last").alias("last"),
                F.when(bad, ROLLED_BACK).otherwise(t.status).alias("status"), F.when(bad, t.failed_chunk.error if t.failed_chunk else None).alias("error"),
            ))
        return out
