"""The corpus pipeline: each stage takes the documents that its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clipgraph_spark.llm import decontam, langid, mixing, near_dup, token_files
from clipgraph_spark.llm.common import materialize, table

STAGES = [
    ("language", langid.stage_language),
    ("near_duplicates", near_dup.stage_near_dup),
    ("decontaminate", decontam.stage_decontaminate),
    ("mix", mixing.stage_mix),
    ("tokens", token_files.stage_tokens),
]

#: SQL cannot express the first, second and last stage; the tests hold each stage's operator against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
