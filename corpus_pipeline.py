"""From raw documents to packed sequences: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evenkeel.llm import decontaminate, language_id, line_dedup, near_dedup, packing
from evenkeel.llm.common import stored

STAGES = [
    ("language ID", language_id.stage),
    ("MinHash near-dedup", near_dedup.stage),
    ("substring dedup", line_dedup.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("best-fit packing", packing.stage),
]

#: Neither alignment nor hashing of units nor packing is SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, _ = stored(docs, name.replace(" ", "-"))
    return docs
