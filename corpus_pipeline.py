"""A corpus pipeline of the operators; each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditlake.llm import decontaminate, line_dedup, quality, sentencepiece_codec, simhash
from auditlake.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return quality.keep_good(docs)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; those of nothing else stay whole, as they may be copies."""
    return line_dedup.drop_boilerplate(docs, "source", keep_whole=True)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return simhash.near_dedup(docs, "doc_id")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, whether they decode to its text, and whether both libraries agree."""
    done = sentencepiece_codec.encode(
        docs.select("doc_id", "lang", "source", "text"), outputs=("ids", "n_tokens", "parity", "round_trip"), keep_text=False
    )
    return done.select("doc_id", "lang", "source", "n_tokens", "ids", "parity", "round_trip")


STAGES = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("near duplicates", near_duplicates_stage),
    ("benchmark", benchmark_stage),
    ("tokens", tokens_stage),
]
# Fingerprints, tiling and pieces are not SQL: tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents; each result is written once and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
