"""A corpus pipeline: documents go through STAGES, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltsieve.llm import stages
from siltsieve.llm._shared import Scratch, table

STAGES = stages.STAGES

#: SQL can't express the stages; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the table documents."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir))
        scratch.drop(but=docs)
    return docs
