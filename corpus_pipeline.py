"""A training corpus from `documents`: good texts of a known language, once each, packed into bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import stages
from tidewatch.plans.stored import stored

STAGES = [
    ("quality", stages.keep_good),
    ("language", stages.keep_known_language),
    ("exact_dedup", stages.drop_copies),
    ("near_dedup", stages.drop_near_copies),
    ("packing", stages.pack_documents),
]

#: Learned models and graph components are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
