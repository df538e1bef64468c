"""Training-corpus pipeline: rejects bad, repeated and contaminated documents, then tokenises the rest.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a
DataFrame that is written as Parquet and reread as the next stage's ``docs``. All stages but the last
return the columns of ``documents``; the last returns ids and digests per kept document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarmac.llm import bpe, decontaminate, exact_dedup, jaccard_join, quality
from tarmac.llm.common import documents, lean_session, staged


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts (score of at least 0.3)."""
    lean_session(spark)
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal normalised text."""
    return exact_dedup.drop_exact_duplicates(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar shingle sets."""
    lean_session(spark)
    return jaccard_join.keep_one_per_group(docs)


def no_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE of each kept document, decoded back for proof."""
    lean_session(spark)
    return bpe.encode_and_decode(docs)


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", no_exact_copies),
    ("jaccard_join", no_near_copies),
    ("decontamination", no_benchmark_text),
    ("bpe", token_ids),
]

#: The fitted classifier has no SQL form; the pipeline is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
