"""A training-data pipeline over `documents`: quality, near duplicates, repeated lines, mix, encoding.

Each stage reads what its predecessor kept, as a written table. The decisions are statistical,
similarity-based or sampled, so SQL can't express them; tests hold each stage's operator against brute force and run
all stages over edge cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evenhand.llm import bpe, mixing, neardup, quality, substring
from evenhand.llm.common import materialize

STAGES = [
    ("quality rules", quality.keep_good),
    ("n-gram Jaccard join", neardup.keep_one),
    ("substring dedup", substring.keep_first_lines),
    ("mixing sources to target weights", mixing.mix),
    ("byte-level BPE encoding and decoding", bpe.encode_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents. Nulls, ties, repeated ids and an empty table as each stage says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
