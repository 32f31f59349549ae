"""Windows over ordered rows: forward fill, runs, levels, rolling percentiles, evictions, folds with resets (F5, F7)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import numbered

UP_TO_NOW = (Window.unboundedPreceding, Window.currentRow)


def forward_fill(value: Column, keys: list[str], order: list[str]) -> Column:
    """WN-10: the last value that isn't null so far."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*UP_TO_NOW))


def change(value: Column, keys: list[str], order: list[str]) -> Column:
    """WN-03: growth in percent over the row before, one decimal; null over zero or a negative base."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return F.when(before > 0, F.round(100 * (value - before) / before, 1) + F.lit(0.0))


def running(value: Column, keys: list[str], order: list[str], digits: int = 4) -> Column:
    """WN-05, WN-06: the running level."""
    return F.round(F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*UP_TO_NOW)), digits)


def islands(present: Column, keys: list[str], order: list[str]) -> Column:
    """WN-09: number of the unbroken run that a row belongs to; a row that isn't present ends one."""
    return F.sum((~present).cast("int")).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*UP_TO_NOW))


def rolling_percentile(value: str, p: float, keys: list[str], order: list[str], rows: int) -> Column:
    """WN-21: interpolated percentile over the last so many rows."""
    return F.percentile(value, F.lit(p)).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - rows, 0))


def evicted(df: DataFrame, key: str, pinned: str, created: list[str], most: int) -> DataFrame:
    """WN-18: the oldest rows that aren't pinned go, so that a key has at most `most`; the newest row always stays. created orders rows without ties."""
    facts = df.groupBy(F.col(key).alias("_of")).agg(F.count(F.lit(1)).alias("_total"), F.max(F.struct(*created)).alias("_newest"))
    aged = numbered(df, [key, pinned], [F.col(c) for c in created], "_age").join(facts, F.col(key).eqNullSafe(F.col("_of")))
    gone = ~F.col(pinned) & (F.struct(*created) != F.col("_newest")) & (F.col("_age") <= F.col("_total") - most)
    return aged.select(*df.columns, gone.alias("evicted"))


def renumbered(keys: list[str], order: list[Column]) -> Column:
    """WN-17: positions from 0."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1


def unique_keys(slug: str, keys: list[str], order: list[str]) -> Column:
    """WN-11: k, k_2, k_3 in order."""
    n = F.row_number().over(Window.partitionBy(*keys, slug).orderBy(*order))
    return F.when(n == 1, F.col(slug)).otherwise(F.concat_ws("_", slug, n.cast("string")))


def stacked(value: Column, keys: list[str], order: list[str], digits: int = 4) -> tuple[Column, Column]:
    """WN-07: where a value's bar starts and ends, positive and negative ones stacked apart."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*UP_TO_NOW)
    up, down = F.sum(F.greatest(value, F.lit(0.0))).over(w), F.sum(F.least(value, F.lit(0.0))).over(w)
    end = F.when(value >= 0, up).otherwise(down)
    return F.round(end - value, digits), F.round(end, digits)


def slices(value: Column, keys: list[str], order: list[str]) -> tuple[Column, Column]:
    """WN-08: cumulative share before and after a slice."""
    w = Window.partitionBy(*keys)
    total, level = F.sum(value).over(w), F.sum(value).over(w.orderBy(*order).rowsBetween(*UP_TO_NOW))
    return F.round(F.try_divide(level - value, total), 6), F.round(F.try_divide(level, total), 6)


def biggest_fall(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """WN-23, AG-31: highest and lowest point, and the largest fall from the point before."""
    d = df.withColumn("_fall", F.lag(value).over(Window.partitionBy(key).orderBy(order)) - F.col(value))
    at = lambda f, c: f(order, F.struct(c, F.col(order)))
    return d.groupBy(key).agg(at(F.max_by, F.col(value)).alias("peak_at"), at(F.min_by, F.col(value)).alias("low_at"), F.max_by(order, F.when(F.col("_fall") > 0, F.struct("_fall", order))).alias("fall_at"), F.round(F.max(F.when(F.col("_fall") > 0, F.col("_fall"))), 4).alias("fall"))


def latest_two(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """WN-04, VQ-07: the last value and the one before, nulls left out, with their difference."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    r = df.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    g = r.groupBy(key).agg(F.max(F.when(F.col("_r") == 1, F.col(value))).alias("value"), F.max(F.when(F.col("_r") == 1, F.col(order))).alias("at"), F.max(F.when(F.col("_r") == 2, F.col(value))).alias("previous"))
    return g.withColumn("delta", F.round(F.col("value") - F.col("previous"), 4)).withColumn("growth", F.when(F.col("previous") > 0, F.round(100 * (F.col("value") - F.col("previous")) / F.col("previous"), 1)))


def overlapping(df: DataFrame, key: str, id_col: str, start: str, seconds: int) -> DataFrame:
    """JN-13: pairs of rows of a key whose windows [start, start + seconds] overlap. Rows meet in time buckets as wide as a window, so only neighbours are compared."""
    t = F.unix_micros(F.col(start).cast("timestamp"))
    span = seconds * 1_000_000
    a = df.select(F.col(key), F.col(id_col), t.alias("t")).withColumn("b", F.floor(F.col("t") / span))
    near = a.select(key, F.col(id_col).alias("other_id"), F.col("t").alias("u"), F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"))
    return a.join(near, [key, "b"]).where((F.col(id_col) < F.col("other_id")) & (F.abs(F.col("t") - F.col("u")) <= span)).select(id_col, "other_id", key)


def folded(df: DataFrame, key: str, order: list[str], step: Callable, start, schema: str) -> DataFrame:
    """A fold over each key's rows in order that emits rows: step(state, row) -> (state, list of rows); at the end step(state, None).

    Rows are dealt by key, sorted within partitions and streamed, so a key's rows are never held together; the state alone is.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        last, state, started = None, None, False
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                k = getattr(row, key)
                if not started or (k != last and not (pd.isna(k) and pd.isna(last))):
                    if started:
                        out += step(state, None)[1]
                    last, state, started = k, start(), True
                state, rows = step(state, row)
                out += rows
            yield pd.DataFrame(out, columns=names)
        if started:
            yield pd.DataFrame(step(state, None)[1], columns=names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
