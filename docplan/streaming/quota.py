"""Per-user quotas on a stream of events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docplan.functions.storage import new_folder
from docplan.operators.usage import decide

SCHEMA = "user_id bigint, event_id bigint, ts timestamp, accepted boolean, retry_after int"
COLUMNS = ["user_id", "event_id", "ts", "accepted", "retry_after"]


def quota_stream(
    events: DataFrame, allowance: int, window_seconds: int, lateness: str | None = None
) -> DataFrame:
    """Decisions of ``quota_audit`` on a stream of (user_id, event_id, ts), however it is cut into batches.

    The state of a user is the accepted times still in force, at most
    ``allowance``. Events of a batch are decided in order of time and id, so a
    stream whose batches follow each other in time gives the batch result.
    An event older than one decided before is judged as it arrives. The
    watermark trails by ``lateness`` (default: one window), events older than
    that are dropped by the engine as in any stream with a watermark; a user's
    state ends by a timer when the watermark has left the window of the last accepted event.
    """
    window = window_seconds * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if pd.isna(key[0]):  # nobody's events
            for rows in batches:
                yield rows.assign(user_id=None, accepted=True, retry_after=np.int32(0))[COLUMNS]
            return
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(batches).sort_values(["ts", "event_id"], kind="stable")
        micros = rows["ts"].to_numpy("datetime64[us]").astype(np.int64)
        late = np.flatnonzero(micros < recent[-1]) if recent else []
        shown = np.maximum(micros, recent[-1]) if len(late) else micros  # time stands still for late events
        accepted, wait, recent = decide(shown, recent, allowance, window)
        state.update((recent,))
        if recent:
            ends = recent[-1] // 1000 + window_seconds * 1000 + 1
            state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield rows.assign(
            user_id=key[0], accepted=accepted, retry_after=np.where(accepted, 0, wait // 1_000_000 + 1).astype(np.int32)
        )[COLUMNS]

    stamped = events.selectExpr("user_id", "event_id", "cast(ts as timestamp) as ts")
    return (
        stamped.withWatermark("ts", lateness or f"{window_seconds} seconds").groupBy("user_id")
        .applyInPandasWithState(step, SCHEMA, "recent array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    )


def write_quota_stream(
    events: DataFrame, allowance: int, window_seconds: int, path: str, checkpoint: str
) -> StreamingQuery:
    """Appends the decisions of all events that have arrived to parquet, once each."""
    return (
        quota_stream(events, allowance, window_seconds).writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def audited(events: DataFrame, allowance: int, window_seconds: int) -> DataFrame:
    """The decisions of a finite stream as a table, by way of the shared folder."""
    spark = events.sparkSession
    path = new_folder(spark, "quota")
    write_quota_stream(events, allowance, window_seconds, path, new_folder(spark, "quota-checkpoint")).awaitTermination()
    return spark.read.schema(SCHEMA).parquet(path)
