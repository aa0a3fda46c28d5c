"""A corpus pipeline out of the operators of the llm subpackage, each stage over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import bpe, exactdedup, mixing, scratch, simhash, toxicity

MIX_SEED = 7
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The near-duplicate stage links texts whose sets of five words have a Jaccard similarity of ``LEAST`` or more. Fingerprints of a pair at 0.8 differ
#: in 9.7 of 64 bits on average, so candidates differ in ``REACH`` of 64 bits and ``BOTH`` of 128; the sets then decide.
SHINGLE_WORDS = 5
REACH = 16
BOTH = 30
LEAST = 0.8

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_ordinary(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exactdedup.keep_distinct(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, width=SHINGLE_WORDS, reach=REACH, both=BOTH, least=LEAST)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs, seed=MIX_SEED).drop("copy")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, public_tokenizers.path(VOCABULARY))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mix sources", mix),
    ("byte-level bpe", tokenize),
]

#: Toxicity, SimHash and BPE aren't expressible; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
