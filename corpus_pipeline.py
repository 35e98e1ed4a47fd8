"""From raw documents to packed training sequences.

Each stage works on all that its predecessor kept; between stages the rows are
written as Parquet to the folder that the cluster shares; a stage's files go when
the next one's are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillan.llm import stages
from quillan.llm.common import remove, stored, table

STAGES = [
    ("language", stages.language),
    ("near_duplicates", stages.near_duplicates),
    ("decontamination", stages.decontamination),
    ("personal_data", stages.personal_data),
    ("packing", stages.sequences),
]

#: Alignment, minhash components and packing are beyond SQL; tests/llm/test_pipeline.py checks run() by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table documents."""
    docs, held = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if held is not None:
            remove(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
