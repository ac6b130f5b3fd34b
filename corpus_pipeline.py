"""The training-data pipeline: each stage applies one corpus operator to what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeline.llm.decontaminate import decontaminate
from sedgeline.llm.mixing import take
from sedgeline.llm.near_dedup import keep_one
from sedgeline.llm.quality import keep_selected
from sedgeline.llm.sharding import assign_shards


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling does not draw go."""
    return keep_selected(docs, _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays."""
    return keep_one(docs, shingle=5, similarity=(80, 100))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"), action="documents")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic text is thinned out to 3 % of the tokens; no document is taken more than once."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean")
    labelled = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), domain.alias("domain"))
    return take(docs, labelled, {"clean": 0.97, "toxic": 0.03}, max_rate=1.0)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its shard and slot; shards have near equal bytes."""
    return assign_shards(docs, 24)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Hash sketches, trained models and iterated labels have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
