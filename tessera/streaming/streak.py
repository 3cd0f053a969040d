"""Sequential-read streaks per handle, as a batch window and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TRIGGER, AHEAD = 3, 4


def streaks(reads: DataFrame) -> DataFrame:
    """Adds streak and prefetch to reads (handle, ts, event_id, off, len): a read goes on where the one before ended."""
    order = Window.partitionBy("handle").orderBy("ts", "event_id")
    goes_on = F.coalesce(F.lag(F.col("off") + F.col("len")).over(order) == F.col("off"), F.lit(False))
    rows = reads.withColumn("_fresh", F.when(goes_on, 0).otherwise(1)).withColumn("_run", F.sum("_fresh").over(order))
    rows = rows.withColumn("streak", (F.row_number().over(Window.partitionBy("handle", "_run").orderBy("ts", "event_id")) - 1).cast("long"))
    return rows.withColumn("prefetch", F.when(F.col("streak") >= TRIGGER, AHEAD).otherwise(0)).drop("_fresh", "_run")


def streaming_streaks(reads: DataFrame, idle_minutes: int = 60) -> DataFrame:
    """The same over a stream of reads; a handle's state is its last end and streak, dropped when idle.

    Time is that of the reads: a watermark ``idle_minutes`` behind the newest read drops
    later ones, and a handle whose last read is that long behind the watermark loses its state. No
    clock is involved, so a stream without new reads comes to rest.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        end, streak = state.get if state.exists else (None, 0)
        # A micro-batch's rows of a handle may come in several pieces, in any order.
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for off, size in zip(rows["off"], rows["len"], strict=True):
            streak = streak + 1 if end == off else 0
            end = int(off + size)
            out.append(streak)
        yield pd.DataFrame({"handle": key[0], "event_id": rows["event_id"].to_numpy(), "streak": out, "prefetch": [AHEAD if s >= TRIGGER else 0 for s in out]})
        state.update((end, streak))
        state.setTimeoutTimestamp(max(int(rows["_ms"].max()), state.getCurrentWatermarkMs()) + idle_minutes * 60_000)

    timed = reads.withColumn("_ms", F.unix_millis("ts")).withWatermark("ts", f"{idle_minutes} minutes")
    return timed.groupBy("handle").applyInPandasWithState(
        follow, "handle long, event_id long, streak long, prefetch int", "end long, streak long", "append", GroupStateTimeout.EventTimeTimeout
    )
