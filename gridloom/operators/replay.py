"""Replay of one series' scored windows in time order, held against a committed record."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import temporal
from .shards import every_kth


def known_windows(index: DataFrame, label: str) -> DataFrame:
    """Windows whose label is known."""
    return index.where(F.col(label).isNotNull())


def step_axis(steps: DataFrame, keys: Sequence[str], order: str, step: int) -> DataFrame:
    """keys, pieces: the contiguous pieces of each key's steps; a replay needs one."""
    from .islands import runs

    return runs(steps, list(keys), order, step).groupBy(*keys).agg(F.count_distinct("run").alias("pieces"), F.min(order).alias("first"), F.max(order).alias("last"))


def events_inside(events: DataFrame, spans: DataFrame, keys: Sequence[str], start: str, horizon: int) -> DataFrame:
    """Events of keys that start from spans.first to spans.last + horizon."""
    return events.join(spans.select(*keys, "first", "last"), list(keys)).where(F.col(start).between(F.col("first"), F.col("last") + horizon)).drop("first", "last")


def trace(windows: DataFrame, events: DataFrame, keys: Sequence[str], time: str, start: str, stride: int, horizon: int, threshold: float) -> DataFrame:
    """windows(keys, time, p, label) at a stride with alarm (p >= threshold), and hours_to_next: hours to the first event after time, null beyond horizon."""
    some = every_kth(windows, keys, time, stride)
    ahead = temporal.asof_forward(some, events, list(keys), time, start, "_next", horizon)
    return ahead.withColumn("alarm", F.col("p") >= threshold).withColumn("hours_to_next", (F.col("_next") - F.col(time)) / 3600.0).drop("_next")


def trace_summary(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, windows, positives, alarms, hits, rate of a trace."""
    y = F.coalesce(F.col("label"), F.lit(False))
    return rows.groupBy(*by).agg(
        F.count("*").alias("windows"), F.count_if(y).alias("positives"), F.count_if("alarm").alias("alarms"), F.count_if(y & F.col("alarm")).alias("hits"), F.avg(y.cast("double")).alias("rate")
    )


def against_record(measured: DataFrame, record: DataFrame, keys: Sequence[str], decimals: Mapping[str, int]) -> DataFrame:
    """keys, column, measured, recorded of values that differ at the printed precision, and of rows that one side lacks; none if all agree."""
    long = lambda df, name: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.round(F.col(c).cast("double"), d).alias(name)) for c, d in decimals.items()])).alias("x")).select(*keys, "x.*")
    both = long(measured, "measured").join(long(record, "recorded"), [*keys, "column"], "full")
    return both.where(~F.col("measured").eqNullSafe(F.col("recorded")))


def interval_in_words(low: Column, high: Column, rate: Column) -> Column:
    """Where an interval lies against the series' own rate."""
    return (
        F.when(low.isNull() | F.isnan(low), "no interval: too few positives").when(low > rate, "above its own rate").when(high < rate, "below its own rate").otherwise("holds its own rate")
    )
