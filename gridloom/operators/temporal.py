"""Temporal joins by one sort: as-of, existence within a range, interval overlap.

As-of and existence joins union both sides and look along one window per key,
so no pair is ever formed. Overlap joins go by time buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _both(left: DataFrame, right: DataFrame, keys: list[str], time: str, right_time: str) -> DataFrame:
    """left's rows with _at null and right's times as _at."""
    times = right.select(*keys, F.col(right_time).alias(time), F.col(right_time).alias("_at"))
    return left.withColumn("_row", F.lit(True)).withColumn("_at", F.lit(None).cast(times.schema["_at"].dataType)).unionByName(times, allowMissingColumns=True)


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], time: str, right_time: str, name: str) -> DataFrame:
    """left with name: the last right time <= time."""
    w = W.partitionBy(*keys).orderBy(time).rangeBetween(W.unboundedPreceding, 0)
    return _both(left, right, keys, time, right_time).withColumn(name, F.max("_at").over(w)).where("_row").drop("_row", "_at")


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], time: str, right_time: str, name: str, within: int | None = None) -> DataFrame:
    """left with name: the first right time > time, null if more than within later."""
    # in falling order what comes later has been seen; equal times are no match
    w = W.partitionBy(*keys).orderBy(F.desc(time)).rangeBetween(W.unboundedPreceding, -1)
    found = _both(left, right, keys, time, right_time).withColumn(name, F.min("_at").over(w)).where("_row").drop("_row", "_at")
    return found if within is None else found.withColumn(name, F.when(F.col(name) - F.col(time) <= within, F.col(name)))


def exists_ahead(left: DataFrame, right: DataFrame, keys: list[str], time: str, right_time: str, horizon: int, name: str) -> DataFrame:
    """left with name: whether a right time lies in (time, time + horizon]."""
    w = W.partitionBy(*keys).orderBy(time).rangeBetween(1, horizon)
    return _both(left, right, keys, time, right_time).withColumn(name, F.count("_at").over(w) > 0).where("_row").drop("_row", "_at")


def exists_behind(left: DataFrame, right: DataFrame, keys: list[str], time: str, right_time: str, span: int, name: str) -> DataFrame:
    """left with name: whether a right time lies in (time - span, time]."""
    w = W.partitionBy(*keys).orderBy(time).rangeBetween(1 - span, 0)
    return _both(left, right, keys, time, right_time).withColumn(name, F.count("_at").over(w) > 0).where("_row").drop("_row", "_at")


def horizon_labels(steps: DataFrame, starts: DataFrame, keys: list[str], horizon_steps: int, name: str, step: int = 600) -> DataFrame:
    """Three-valued label of each step: true with a start in (t, t + H]; else false if all H steps ahead are covered; else null.

    steps has keys, step and a row per covered step; starts has keys and start.
    """
    span = horizon_steps * step
    times = starts.select(*keys, F.col("start").alias("step"), F.lit(1).alias("_hit"), F.lit(0).alias("_cover"))
    both = steps.withColumn("_hit", F.lit(0)).withColumn("_cover", F.lit(1)).unionByName(times, allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy("step").rangeBetween(1, span)
    hit, cover = F.coalesce(F.sum("_hit").over(w), F.lit(0)), F.coalesce(F.sum("_cover").over(w), F.lit(0))
    label = F.when(hit > 0, True).when(cover >= horizon_steps, False)
    return both.withColumn(name, label).where("_cover = 1").drop("_hit", "_cover")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], bucket: int) -> DataFrame:
    """Pairs of half-open intervals (start, end) of equal keys that overlap, right's columns as start2, end2.

    Both sides are cut to time buckets; a pair counts in the bucket where its
    overlap begins, so it appears once.
    """
    def cut(df, s, e):
        return df.where(F.col(e) > F.col(s)).withColumn("_b", F.explode(F.sequence(F.expr(f"{s} div {bucket}"), F.expr(f"({e} - 1) div {bucket}"))))

    r = cut(right.withColumnsRenamed({"start": "start2", "end": "end2"}), "start2", "end2")
    pairs = cut(left, "start", "end").join(r, [*keys, "_b"])
    begins = F.greatest("start", "start2")
    return pairs.where((F.col("start") < F.col("end2")) & (F.col("start2") < F.col("end")) & (F.floor(begins / bucket) == F.col("_b"))).drop("_b")


def opening_message(events: DataFrame, stops: DataFrame, keys: list[str], within: int = 600) -> DataFrame:
    """events(start) with opening: the message of the first stop in [start, start + within), else of the latest stop before start, else null."""
    marks = stops.select(*keys, F.col("at").alias("start"), F.struct("at", "message").alias("_s"))
    both = events.withColumn("_row", F.lit(True)).withColumn("_s", F.lit(None).cast(marks.schema["_s"].dataType)).unionByName(marks, allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy("start")
    first = F.min("_s").over(w.rangeBetween(0, within - 1))
    last = F.max("_s").over(w.rangeBetween(W.unboundedPreceding, -1))
    return both.withColumn("opening", F.coalesce(first["message"], last["message"])).where("_row").drop("_row", "_s")
