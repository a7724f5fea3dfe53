"""From raw documents to packed sequences: toxicity, language, near-duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadloom.llm.common import new_folder, table
from roadloom.llm.language_bitmask import language_stage
from roadloom.llm.near_copies import near_copies_stage
from roadloom.llm.packing import packing_stage
from roadloom.llm.toxicity_pu import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_duplicates", near_copies_stage),
    ("packing", packing_stage),
]

#: The stages train models and call a tokenizer, which SQL can't express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
