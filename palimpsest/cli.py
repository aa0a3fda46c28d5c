"""``python -m palimpsest sanitize CONFIG [--dry-run] [--force] [--chunk N] [--target T]``

CONFIG is a Python file that defines ``build(spark, env) -> Engine``.
"""

from __future__ import annotations

import argparse
import os
import re
import runpy
import sys
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from .config import ProgressEvent, RunOptions
from .errors import PalimpsestError
from .plans.report import RunReport

PRINTABLE = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9A-HJKMNP-TV-Z]{26}", re.IGNORECASE)


def printable(key: Any) -> str | None:
    """An identity may be a natural key, so only integers, UUIDs and ULIDs are shown."""
    if isinstance(key, dict):
        parts = [(c, printable(v)) for c, v in key.items()]
        if any(p is None for _, p in parts):
            return None
        return parts[0][1] if len(parts) == 1 else ", ".join(f"{c}={p}" for c, p in parts)
    if isinstance(key, int) and not isinstance(key, bool):
        return str(key)
    return key if isinstance(key, str) and PRINTABLE.fullmatch(key) else None


def summary(report: RunReport) -> str:
    lines = []
    for t in report.targets:
        if t.skipped:
            lines.append(f"{t.target}: skipped ({t.skipped})")
            continue
        what = "would change" if report.dry_run else "changed"
        counts = ", ".join(f"{c} {n}" for c, n in t.changed.items())
        lines.append(f"{t.target}: {t.rows} rows in {t.expected_chunks} chunks of {t.chunk_size}; {what}: {counts}")
        if not t.fk_enforcement:
            lines.append("  its foreign keys are rewritten on both sides; check for orphans afterwards")
        if t.failed_chunk:
            c = t.failed_chunk
            first, last = printable(c.first), printable(c.last)
            keys = f" (keys {first} to {last})" if first and last else ""
            lines.append(f"  chunk {c.chunk}{keys} was not written: {c.error}; {t.chunks_not_attempted} chunks not attempted")
    lines += [f"{label}: not attempted" for label in report.not_attempted]
    lines.append("dry run: nothing was written" if report.dry_run else f"{report.rows_sanitized} rows sanitized")
    return "\n".join(lines)


def _positive(text: str) -> int:
    if not text.isdigit() or int(text) < 1:
        raise argparse.ArgumentTypeError("a positive whole number is needed")
    return int(text)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, ask: Callable[[str], str] = input) -> int:
    parser = argparse.ArgumentParser(prog="palimpsest")
    parser.add_argument("command", choices=["sanitize"])
    parser.add_argument("config")
    parser.add_argument("--dry-run", action="store_true")
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--chunk", type=_positive)
    parser.add_argument("--target", action="append")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("palimpsest").getOrCreate()
    engine = runpy.run_path(args.config)["build"](spark, os.environ)
    allowed = engine.config.environment in engine.config.environments
    confirmed = not allowed and args.force and ask(f"Rewrite data in {engine.config.environment}? Type yes: ").strip() == "yes"

    def progress(e: ProgressEvent) -> None:
        print(f"{e.target}: {e.rows} rows" + (f", chunk {e.chunk} of {e.chunks}" if e.chunk else ""), file=sys.stderr)

    try:
        report = engine.run(RunOptions(args.chunk, args.dry_run, args.force, confirmed, args.target, progress))
    except PalimpsestError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    print(summary(report))
    return int(report.failed)
