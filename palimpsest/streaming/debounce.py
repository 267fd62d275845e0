"""Debounced signals: the first event of a key arms a timer, events while it is armed are dropped, its end is one signal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_MICROS = 1_000_000


def _fold(wait: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, armed, dropped = None, None, 0
        for batch in batches:
            out: list[tuple[str, int, int]] = []
            for k, t in zip(batch.column("key").to_pylist(), batch.column("t").to_pylist()):
                if armed is not None and (k != key or t >= armed):
                    out.append((key, armed, dropped))
                    armed = None
                if armed is None:
                    key, armed, dropped = k, t + wait, 0
                else:
                    dropped += 1
            yield _signals(out)
        if armed is not None:
            yield _signals([(key, armed, dropped)])

    return fold


def _signals(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[], [], []]
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64()))], names=["key", "t", "dropped"])


def debounced(events: DataFrame, key: str, ts: str, seconds: float) -> DataFrame:
    """(key, signal_at, dropped) of a table of events: when each signal comes, and how many events it stands for besides the first.

    Partitions hold whole keys in the order of time and are folded as a stream, so a key with most
    of the events needs no memory for them. Rows with a null key or time are left out.
    """
    rows = events.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).where("key is not null and t is not null")
    folded = rows.repartition("key").sortWithinPartitions("key", "t").mapInArrow(_fold(int(seconds * _MICROS)), "key string, t long, dropped long")
    return folded.select("key", F.timestamp_micros("t").alias("signal_at"), "dropped")


def debounced_stream(events: DataFrame, key: str, ts: str, seconds: float, late: str = "0 seconds") -> DataFrame:
    """(key, signal_at, dropped) of a stream of events in event time; the watermark ends timers.

    State is one time and one count for each armed key.
    """
    wait = int(seconds * 1000)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        armed, dropped = state.get if state.exists else (None, 0)
        out: list[tuple[str, int, int]] = []
        if state.hasTimedOut:
            out.append((k[0], armed, dropped))
            armed = None
        else:
            times = np.sort(np.concatenate([f["t"].to_numpy() for f in frames]))
            for t in times.tolist():
                if armed is not None and t >= armed:
                    out.append((k[0], armed, dropped))
                    armed = None
                if armed is None:
                    armed, dropped = t + wait, 0
                else:
                    dropped += 1
        if armed is None:
            state.remove()
        else:
            state.update((armed, dropped))
            state.setTimeoutTimestamp(max(armed, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "t", "dropped"])

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("at"), F.unix_millis(F.col(ts).cast("timestamp")).alias("t")).where("key is not null and at is not null")
    out = rows.withWatermark("at", late).groupBy("key").applyInPandasWithState(step, "key string, t long, dropped long", "armed long, dropped long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("key", F.timestamp_millis("t").alias("signal_at"), "dropped")
