"""Profiles of channels, events and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def to_long(df: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """keys, channel, value: wide to long."""
    return df.unpivot([F.col(k) for k in keys], [F.col(c).cast("double").alias(c) for c in channels], "channel", "value")


def coverage(df: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """keys and the non-null share of each channel."""
    return df.groupBy(*keys).agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in channels])


def ranges(df: DataFrame, by: Sequence[str], value: str, bounds: tuple[float, float], codes: Sequence[float]) -> DataFrame:
    """Count, range, quantiles, and counts out of bounds and at sentinel codes."""
    v = F.col(value)
    hit = F.lit(False)
    for code in codes:
        hit = hit | (F.abs(v - code) <= 1e-4)
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.05, 0.5, 0.95)]))
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), q.alias("_q"),
        F.count_if((v < bounds[0]) | (v > bounds[1])).alias("out_of_bounds"), F.count_if(hit).alias("sentinels"),
    ).select("*", *[F.col("_q")[k].alias(n) for k, n in enumerate(("p05", "p50", "p95"))]).drop("_q")


def event_summary(df: DataFrame, by: Sequence[str], code: Column, message: Column) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("events"), F.count_distinct(code).alias("codes"), F.count_distinct(F.when(message != "", message)).alias("messages"),
        F.avg((message != "").cast("double")).alias("free_text_share"),
    )


def key_sets(df: DataFrame, payload: str, by: Column, name: str) -> DataFrame:
    """keys (sorted names of a JSON object) and the distinct by values that have them, sorted."""
    keys = F.array_join(F.array_sort(F.json_object_keys(payload)), ",")
    return df.groupBy(keys.alias("keys")).agg(F.array_join(F.array_sort(F.collect_set(by.cast("string"))), ",").alias(name), F.count("*").alias("n"))


def bucket_shares(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """bucket, n, share over half-open buckets between edges."""
    place = sum((F.when(F.col(value) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    counts = df.groupBy(place.alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def gap_histogram(df: DataFrame, keys: Sequence[str], order: str, step: int) -> DataFrame:
    """gap (missing steps between neighbours), n."""
    w = W.partitionBy(*keys).orderBy(order)
    gap = F.expr(f"({order} - _p) div {step}") - 1
    return df.withColumn("_p", F.lag(order).over(w)).where("_p is not null").select(gap.alias("gap")).where("gap > 0").groupBy("gap").agg(F.count("*").alias("n"))


def top_values(df: DataFrame, value: str, n: int) -> DataFrame:
    """The n most frequent values, ties by name, with their share of all rows."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    top = counts.orderBy(F.desc("n"), value).limit(n)
    return top.join(F.broadcast(total)).select(value, "n", (F.col("n") / F.col("_t")).alias("share"))


def onset_profile(df: DataFrame, seconds: str) -> DataFrame:
    """weekday (0 = Monday), hour, n, share of starts."""
    day = F.pmod(F.expr(f"{seconds} div 86400") + 3, F.lit(7)).cast("int")
    hour = F.expr(f"cast(({seconds} % 86400) div 3600 as int)")
    counts = df.groupBy(day.alias("weekday"), hour.alias("hour")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def clock_fingerprint(df: DataFrame, keys: Sequence[str], step: str, spring: tuple[int, int], autumn: tuple[int, int]) -> DataFrame:
    """Steps in the hour that clocks skip, and repeats in the hour that they double."""
    t = F.col(step)
    inside = lambda span: (t >= span[0]) & (t < span[1])
    return df.groupBy(*keys).agg(
        F.count_if(inside(spring)).alias("in_missing_hour"),
        (F.count_if(inside(autumn)) - F.count_distinct(F.when(inside(autumn), t))).alias("repeated"),
    )


def percentile_summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """count, mean, population deviation, min, median, max of finite values."""
    v = F.when(~F.isnan(value) & (F.abs(F.col(value)) < float("inf")), F.col(value))
    return df.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("low"), F.percentile(v, F.lit(0.5)).alias("median"), F.max(v).alias("high")
    )
