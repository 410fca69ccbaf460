"""Job events as a stream: current states by job, and events thinned out with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TERMINAL = ("done", "error")


def current_states(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """The last state of each job; for update or complete mode."""
    return events.withWatermark("ts", watermark).groupBy("job").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("ts"))


def progress_windows(events: DataFrame, width: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Events by window and state; late ones beyond the watermark are dropped."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", width), "state").agg(F.count("*").alias("n"))


def throttled(events: DataFrame, seconds: float = 0.15) -> DataFrame:
    """Events that change the state, end the job, or come `seconds` after the last that was let through."""
    step = int(seconds * 1e6)

    def passed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at = state.get if state.exists else (None, 0)
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        keep = []
        was = last
        for s, t in zip(pdf["state"], pdf["ts"], strict=True):
            micros = t.value // 1000
            ok = s != was or s in TERMINAL or micros - at >= step
            keep.append(ok)
            was, at = s, micros if ok else at
        state.update((was, at))
        yield pdf[keep]

    return events.groupBy("job").applyInPandasWithState(passed, events.schema, "last string, at long", "append", GroupStateTimeout.NoTimeout)
