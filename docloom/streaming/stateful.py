"""Stateful operators on streams: the step functions under applyInPandasWithState, and session windows with a watermark."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stateful(df: DataFrame, key: str, order: list[str], step: Callable, schema: str, idle_ms: int | None = None) -> DataFrame:
    """Runs step over each key's rows, in order within a batch, keeping its state between batches.

    With idle_ms a key from which nothing came for so long is ended by step(state, None) and its state removed.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = pickle.loads(state.get[0]) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame(step(now, None)[1], columns=names)
            return
        parts = list(frames)
        out: list[tuple] = []
        for row in (pd.concat(parts) if len(parts) > 1 else parts[0]).sort_values(order).itertuples(index=False):
            now, rows = step(now, row)
            out += rows
        state.update((pickle.dumps(now),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=names)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return df.groupBy(key).applyInPandasWithState(run, schema, "state binary", "append", timeout)


def sessions(df: DataFrame, key: str, at: str, gap: str, late: str | None = None) -> DataFrame:
    """ST-02: sessions of a key that end after a gap; with `late`, on a stream, rows later than that are dropped."""
    d = df.withColumn("_at", F.col(at).cast("timestamp"))
    if late:
        d = d.withWatermark("_at", late)
    s = d.groupBy(F.session_window("_at", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return s.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n", "total")


def barge_in(heard_ms: Column, stop_phrase: Column, sure: Column, backchannel: Column, ended: Column, waited_ms: Column, transcribing: Column) -> Column:
    """ST-05: stop, resume or wait while the user speaks over an answer."""
    return (
        F.when(stop_phrase, "stop").when(sure & ~backchannel, "stop").when(ended, "resume").when(waited_ms < 700, "wait").when(heard_ms < 250, "resume")
        .when(transcribing, F.when(waited_ms < 2500, "wait").otherwise("stop")).when(backchannel, F.when(waited_ms < 1500, "wait").otherwise("resume")).otherwise("stop")
    )


def batches(df: DataFrame, key: str, arrived_ms: str, settle: int, deadline: int) -> DataFrame:
    """ST-12: results by when they come: the first batch at the settle time, later ones in turn, none past the deadline."""
    t = F.col(arrived_ms)
    return df.where(t <= deadline).withColumn("batch", F.when(t <= settle, 0).otherwise(1 + F.floor((t - settle) / settle)).cast("int"))
