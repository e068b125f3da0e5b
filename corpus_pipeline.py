"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's documents.

Low quality goes, then exact copies (the largest doc_id of equal texts stays), then near copies (the smallest doc_id of a
group of similarity 0.8 on shingles of five words stays), then documents that hold benchmark passages; what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinetra.llm import common, decontaminate, exact_dedup, near_dedup, quality, sentence_pieces

STAGES = [
    ("quality classifier", quality.stage_quality),
    ("exact dedup", exact_dedup.stage_exact_dedup),
    ("near dedup", near_dedup.stage_near_dedup),
    ("decontamination", decontaminate.stage_decontaminate),
    ("sentence pieces", sentence_pieces.stage_encode),
]

#: Model scores and subword merges have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
