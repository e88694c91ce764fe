"""Training-data pipeline: STAGES applied to documents one after the other.

Every stage reads all rows that the stage before it kept, written as Parquet, and all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logloom.llm.bpe import encode_decode
from logloom.llm.common import materialise, table
from logloom.llm.mixing import mix_sources
from logloom.llm.near_duplicates import dedup_lines, drop_near_duplicates
from logloom.llm.queries import tokenizer_path
from logloom.llm.toxicity import drop_toxic, train_on

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents of its input; those that it rejects go."""
    model = train_on(docs, table(spark, sf_dir, "labels"))
    return drop_toxic(docs.select(*COLUMNS), model, threshold=0.3)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier one go; every document stays."""
    return dedup_lines(docs.select(*COLUMNS), k=5, percent=80)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id stays, once if it is repeated."""
    return drop_near_duplicates(docs.select(*COLUMNS), k=5, percent=80, keep_repeats=False)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows as before on average, sources in proportion to the root of their size."""
    return mix_sources(docs, alpha=0.5, epochs=1.0, seed=17).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token ids, their count, and digests of ids and decoded text."""
    return encode_decode(docs, tokenizer_path(), carry=COLUMNS, keep=("ids",))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("encoding", encoding)]

#: The classifier and the tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
