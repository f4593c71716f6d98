"""Spark helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows handed to Python at once; texts are long, and a worker holds two or three such batches.
BATCH_ROWS = 1000


def modest_batches(spark: SparkSession) -> None:
    """From now on the session hands at most BATCH_ROWS rows at once to Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this application, below what spark.checkpoint.dir names.

    Where that is unset, a session on one machine (tests) gets a temporary one; on a cluster it is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="docplan-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """The frame written to the shared checkpoint folder and read from there: its lineage ends."""
    modest_batches(df.sparkSession)
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_of(column: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def free_name(df: DataFrame, wish: str) -> str:
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def keep_where(docs: DataFrame, decide: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows, all columns, for which `decide` is true of a batch's rows."""
    modest_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(np.asarray(decide(batch), bool)))

    return docs.mapInArrow(run, docs.schema)


def least_scrambled(df: DataFrame, column: str, rows: int) -> DataFrame:
    """The `rows` rows of least scrambled `column`: a sample that no layout of the table changes.

    A bound on the scrambled value leaves about twice as many rows to sort, whatever the table's size.
    """
    total = df.count()
    bound = -(1 << 63) + ((1 << 64) - 1) * min(2 * rows + 1000, total) // max(total, 1)
    scrambled = F.xxhash64(column)
    return df.where(scrambled <= F.lit(min(bound, (1 << 63) - 1))).orderBy(scrambled, column).limit(rows)
