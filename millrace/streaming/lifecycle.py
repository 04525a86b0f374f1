"""The lifecycle of sources as a stateful stream: the rules of operators.lifecycle, one snapshot after the other.

State per source: newest event time, misses in a row, and active or not. A snapshot that is not newer than the newest one is emitted with
applied = false and changes nothing (it is not dropped). Within a micro-batch a source's snapshots are taken in order of time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lifecycle import MISSES_TO_DEACTIVATE

OUTPUT = "key long, id long, applied boolean, missing long, active boolean"
STATE = "newest double, newest_id long, missing long"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    newest, newest_id, missing = state.get if state.exists else (float("-inf"), -1, 0)
    out = []
    rows = pd.concat(list(batches)).sort_values(["at", "id"])
    for at, number, seen in zip(rows["at"], rows["id"], rows["seen"], strict=True):
        applied = (at, number) > (newest, newest_id)
        if applied:
            newest, newest_id, missing = float(at), int(number), 0 if seen else missing + 1
        out.append((int(key[0]), int(number), bool(applied), int(missing), missing < MISSES_TO_DEACTIVATE))
    state.update((newest, newest_id, missing))
    yield pd.DataFrame(out, columns=["key", "id", "applied", "missing", "active"])


def lifecycle(snapshots: DataFrame) -> DataFrame:
    """snapshots: stream of (key, id, at in seconds, seen). A row for each, with the state after it."""
    rows = snapshots.select(F.col("key").cast("long"), F.col("id").cast("long"), F.col("at").cast("double"), "seen")
    return rows.groupBy("key").applyInPandasWithState(_advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, at: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts by tumbling window, emitted when the watermark has passed the window's end."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, at: str, gap: str, late: str, *keys: str) -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n"))


def drained(stream: DataFrame, checkpoint: str, path: str) -> DataFrame:
    """What is available now, through the stream into files, and those files."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
