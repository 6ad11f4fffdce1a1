"""From raw documents to packed training sequences, in stages that each write their result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cedarlog.llm import stages
from cedarlog.llm.common import materialize, table

STAGES = stages.STAGES

#: A trained classifier, signatures and an online packing have no SQL form: tests/llm/ compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to the documents; every stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
