"""The corpus pipeline: each stage reads what the one before it kept."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import neardup, packing, pii, quality, toxicity

STAGES = [
    ("quality rules", quality.stage),
    ("toxicity", toxicity.stage),
    ("near-duplicates", neardup.stage),
    ("personal data", pii.stage),
    ("packing", packing.stage),
]
#: Trained networks and sketches are no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder before the next one reads it."""
    from tidemark.llm._common import cut, read

    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else cut(docs), sf_dir)
    return docs
