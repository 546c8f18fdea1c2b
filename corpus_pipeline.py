"""The corpus pipeline: STAGES in order, each reading what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, mixing, ngram_join, quality_rules, token_files
from tidemark.session import delete_folder, scratch

STAGES = [
    ("quality rules", quality_rules.filter_stage),
    ("n-gram Jaccard join", ngram_join.near_duplicate_stage),
    ("benchmark decontamination", decontaminate.decontaminate_stage),
    ("mixing sources to target weights", mixing.mixing_stage),
    ("token-ID / binary output", token_files.tokens_stage),
]

#: Several stages are not expressible in SQL; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; between stages the rows are written to the shared folder, where
    what a stage has read is deleted once its own rows are written."""
    folder = scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}")
            if i:
                delete_folder(spark, f"{folder}/{i - 1}")
            docs = spark.read.parquet(f"{folder}/{i}")
    return docs
