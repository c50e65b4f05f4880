"""Splits by time and site, exclusions, admissible windows, leakage checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def time_split(t: Column, train_until: int, val_until: int) -> Column:
    """Cuts are inclusive; what is later is 'test'."""
    return F.when(t <= train_until, "train").when(t <= val_until, "val").otherwise("test")


def assign_split(t: Column, site: Column, source: Column, train_until: int, val_until: int, holdout_sites: Sequence[str], evaluation_sources: Sequence[str]) -> Column:
    """Time split, then hold-out sites, then evaluation-only sources, the last rule winning."""
    out = time_split(t, train_until, val_until)
    if holdout_sites:
        out = F.when(site.isin(*holdout_sites), "holdout").otherwise(out)
    if evaluation_sources:
        out = F.when(source.isin(*evaluation_sources), "evaluation").otherwise(out)
    return out


def split_end(split: Column, train_until: int, val_until: int) -> Column:
    """Last second of a row's split; null if unbounded."""
    return F.when(split == "train", F.lit(train_until)).when(split == "val", F.lit(val_until)).cast("long")


def in_spans(source: Column, t: Column, spans: Sequence[tuple[str, int, int]]) -> Column:
    out = F.lit(False)
    for name, start, end in spans:
        out = out | ((source == name) & t.between(start, end))
    return out


def reads_spans(source: Column, split: Column, t: Column, spans: Sequence[tuple[str, int, int]], context: int, step: int = 600) -> Column:
    """A training row whose context [t - (context - 1) steps, t] touches a span of its source."""
    reach = (context - 1) * step
    out = F.lit(False)
    for name, start, end in spans:
        out = out | ((source == name) & (split == "train") & (t >= start) & (t - reach <= end))
    return out


def window_ends(df: DataFrame, keys: list[str], context: int, stride: int, horizon: int, train_until: int, val_until: int, step: int = 600) -> DataFrame:
    """Rows (step, segment_id, split) at which a window of context steps may end.

    In a segment that began early enough, on a stride counted from the epoch,
    with the horizon inside the split.
    """
    begin = F.min("step").over(W.partitionBy(*keys, "segment_id"))
    end = split_end(F.col("split"), train_until, val_until)
    ok = (
        (F.col("segment_id") >= 0)
        & (F.col("step") - F.col("_begin") >= (context - 1) * step)
        & (F.pmod(F.expr(f"step div {step}"), F.lit(stride)) == 0)
        & (end.isNull() | (F.col("step") + horizon * step <= end))
    )
    return df.withColumn("_begin", begin).where(ok).drop("_begin")


def cut_segments(df: DataFrame, keys: list[str]) -> DataFrame:
    """Renumbers segments so that none goes on over a change of split; -1 stays."""
    w = W.partitionBy(*keys).orderBy("step")
    inside = F.col("segment_id") >= 0
    fresh = F.col("segment_id") != F.lag("segment_id").over(w)
    fresh = fresh | (F.col("split") != F.lag("split").over(w))
    mark = F.when(inside & F.coalesce(fresh, F.lit(True)), 1).otherwise(0)
    number = F.sum(mark).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1
    return df.withColumn("segment_id", F.when(inside, number).otherwise(F.lit(-1)).cast("long"))


def leaking_segments(df: DataFrame, keys: list[str]) -> DataFrame:
    """Segments with more than one split; must be empty."""
    return df.where("segment_id >= 0").groupBy(*keys, "segment_id").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def leaking_windows(ends: DataFrame, context: int, horizon: int, train_until: int, val_until: int, step: int = 600) -> DataFrame:
    """Windows whose start or horizon falls in another split than their end; must be empty."""
    start = time_split(F.col("step") - (context - 1) * step, train_until, val_until)
    ahead = time_split(F.col("step") + horizon * step, train_until, val_until)
    return ends.where((start != F.col("split")) | (ahead != F.col("split")))


def every_kth(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """Rows 0, k, 2k, ... of each key."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("_n", n).where(F.col("_n") % k == 0).drop("_n")
