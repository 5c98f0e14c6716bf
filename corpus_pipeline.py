"""The corpus pipeline: each stage works on all that the one before it kept, written as Parquet and read again.

toxicity: documents that the grammar rejects go; line_dedup: later copies of three-line windows go, and documents of which nothing else is left; near_duplicates: the smallest doc_id of
each component of the Jaccard join stays; decontamination: documents with any window of eight words of a benchmark item go; packing: the rest becomes sequences of 4096 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codexlake.llm import decontamination, jaccard, line_dedup, packing, toxicity
from codexlake.llm.common import prepare, shared_dir, written

STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", line_dedup.stage),
    ("near_duplicates", jaccard.stage),
    ("decontamination", decontamination.stage),
    ("packing", packing.stage),
]

#: Scoring, components and token ids are beyond SQL; tests/llm/test_operators.py holds the operators against brute force and sends planted cases through the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the whole of documents."""
    docs, where = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), where, name)
    return STAGES[-1][1](spark, docs, sf_dir)
