"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

Quality and toxicity drop documents, near-duplicate removal keeps one of each group, mixing
gives every source its share, and the last stage encodes what remains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import queries
from orrery.shared import stored

STAGES = [
    ("quality classifier", queries.keep_quality),
    ("toxicity", queries.keep_civil),
    ("simhash near-dedup", queries.keep_distinct),
    ("mixing sources", queries.mix_sources),
    ("byte-level bpe", queries.encode_bytes),
]

#: The models and hashes of the stages are outside SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"), "zstd")
    return docs
