"""Sessions of activity as custom state with event-time timers, and a count of the rows that came too late."""

import threading
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from panelspark.streaming.jobs import run_to_parquet

STATE = "starts array<bigint>, ends array<bigint>, counts array<bigint>"


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans (start, end, count) that overlap become one; an end belongs to no span."""
    out: list[tuple[int, int, int]] = []
    for start, end, n in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2] + n)
        else:
            out.append((start, end, n))
    return out


def spans_of(at: np.ndarray, gap: int) -> list[tuple[int, int, int]]:
    at = np.sort(at)
    first = np.flatnonzero(np.r_[True, np.diff(at) >= gap])
    last = np.r_[first[1:], len(at)] - 1
    return [(int(at[a]), int(at[b]) + gap, int(b - a + 1)) for a, b in zip(first, last, strict=True)]


def closing(gap: int) -> Callable:
    """The step of one user: new rows widen the open spans, spans that the watermark has passed are told and forgotten.
    Rows come in Arrow batches and only spans are kept, so memory follows the sessions that are open at one time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        spans = list(zip(*state.get, strict=True)) if state.exists else []
        if not state.hasTimedOut:
            for frame in frames:
                if len(frame):
                    spans = merged([*spans, *spans_of(frame["at"].to_numpy(), gap)])
        mark = state.getCurrentWatermarkMs()
        done = [s for s in spans if s[1] // 1000 < mark]
        left = [s for s in spans if s[1] // 1000 >= mark]
        if left:
            state.update(tuple([int(s[i]) for s in left] for i in range(3)))
            state.setTimeoutTimestamp(max(min(s[1] for s in left) // 1000, 1))
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame({"key": [key[0]] * len(done), "start": [s[0] for s in done], "end": [s[1] for s in done], "n": [s[2] for s in done]})

    return step


def closed_sessions(stream: DataFrame, key: str = "user_id", gap_seconds: int = 21_600, delay: str = "1 day") -> DataFrame:
    """``key, start, end, n`` of each session once the watermark is past its end: rows less than the gap apart are one
    session, which ends a gap after its last row. Rows without a time or behind the watermark are dropped; a null key is one user."""
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.where("ts IS NOT NULL").withWatermark("ts", delay).select(F.col(key).alias("key"), "ts", F.unix_micros("ts").alias("at"))
    out = rows.groupBy("key").applyInPandasWithState(
        closing(gap_seconds * 1_000_000), f"key {kind}, start bigint, end bigint, n bigint", STATE, "append", "EventTimeTimeout")
    return out.select(F.col("key").alias(key), F.timestamp_micros("start").alias("start"), F.timestamp_micros("end").alias("end"), "n")


class LateRows(StreamingQueryListener):
    """Adds up what the stateful operators of one query dropped behind the watermark."""

    def __init__(self) -> None:
        self.dropped, self.ended = 0, threading.Event()

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        self.dropped += sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

    def onQueryTerminated(self, event) -> None:
        self.ended.set()


def run_counting_late(stream: DataFrame, path: str) -> tuple[DataFrame, int]:
    """The stream's rows so far, and how many input rows of its state came too late; for one query at a time."""
    spark, late = stream.sparkSession, LateRows()
    spark.streams.addListener(late)
    try:
        out = run_to_parquet(stream, path)
        late.ended.wait(60)
    finally:
        spark.streams.removeListener(late)
    return out, late.dropped
