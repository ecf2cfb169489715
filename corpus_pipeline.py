"""The corpus pipeline: stages (name, function), each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import exact_dedup, mixing, near_dup, packing, shared, toxicity

STAGES = [
    ("toxicity", toxicity.stage),
    ("exact_dedup", exact_dedup.stage),
    ("ngram_jaccard_join", near_dup.stage),
    ("source_mix", mixing.stage),
    ("sum_of_squares_packing", packing.stage),
]

#: Classifiers and packing can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder, and what a stage wrote on the way is deleted."""
    docs = shared.documents(spark, sf_dir)
    for name, stage in STAGES:
        path = shared.scratch_path(spark, name)
        with shared.cleared(spark):
            found = stage(spark, docs, sf_dir)
            found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
    return docs
