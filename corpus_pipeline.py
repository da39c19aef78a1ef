"""A corpus pipeline over ``documents``: quality, near-duplicates, benchmark, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows the one before it kept. Stages are
written to Parquet in the cluster's shared folder and read again, so that a lost executor costs one
stage's tasks. All but the last return the columns of ``documents``.

In every stage a null text counts as an empty one, texts are read whole however long they are, extra
columns stay with any name, and an empty table gives an empty one. A text without words weighs 1 in
the first stage, is alike with all others of its kind in the second, and passes the rest unchanged.
Rows that repeat an id and a text are drawn together; one of them passes the second stage. Ties there
go to the smallest id, null ids last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanframe.llm import bpe, decontaminate, pii, resample, simhash
from gleanframe.llm.common import table
from gleanframe.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling; the rest are rejected."""
    return resample.keep_drawn(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by SimHash (three-word shingles, two bits of 64): that of the smallest id."""
    return simhash.keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and disclosing terms replaced; ``n_chars`` follows the text."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: id, number of tokens, and digests of the ids and of the decoded text."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("pii", personal_data),
    ("bpe_tokens", tokens),
]

#: The stages cannot be said in SQL; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
