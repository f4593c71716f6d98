"""A training-data pipeline of five of the operators: from `documents` to packed sequences.

Each stage works on all that the stage before it kept, returns the columns of documents (the last one
the packed pieces), and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docplan.llm import decontamination, near_copies, packing, quality, toxicity
from docplan.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity machine does not reject."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_junk(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality model does not reject."""
    return quality.without_junk(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies."""
    return near_copies.without_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept rows as pieces of sequences."""
    return packing.packed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_junk),
    ("near_copies", drop_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can express neither the trained models nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
