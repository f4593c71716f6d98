"""Streaming use of the operators.

Extraction operators are stateless projections: they take a streaming
DataFrame as they take a batch one. ``extract_stream`` is the common case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from docplan.operators.temporal import extract_temporal


def extract_stream(docs: DataFrame, today: str, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the temporal expressions of arriving documents to parquet, once each."""
    return (
        extract_temporal(docs, today).writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
