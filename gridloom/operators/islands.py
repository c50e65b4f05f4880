"""Gaps and islands: runs, interval unions, allocation to a grid, gap filling.

Every window is keyed, so work spreads over keys; a time-series key (a turbine's
year) is bounded by its own length, not by the table's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def runs(df: DataFrame, keys: list[str], order: str, gap: int, name: str = "run") -> DataFrame:
    """Numbers runs (from 0) of rows whose order values are at most gap apart."""
    w = W.partitionBy(*keys).orderBy(order)
    fresh = (F.col(order) - F.lag(order).over(w) > gap).cast("int")
    return df.withColumn(name, F.sum(F.coalesce(fresh, F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long"))


def change_runs(df: DataFrame, keys: list[str], order: str, watched: list[str], name: str = "run") -> DataFrame:
    """Numbers runs (from 0) of rows that agree in the watched columns, nulls equal."""
    w = W.partitionBy(*keys).orderBy(order)
    same = F.lit(True)
    for c in watched:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    fresh = F.when(F.row_number().over(w) == 1, 0).otherwise((~same).cast("int"))
    return df.withColumn(name, F.sum(fresh).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long"))


def interval_union(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Unions of overlapping or touching intervals: keys, start, end. Rows with a null bound or end <= start are left out."""
    w = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    good = df.where(F.col(end) > F.col(start)).withColumn("_new", (F.col(start) > reach).cast("int"))
    good = good.withColumn("_island", F.sum(F.coalesce("_new", F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return good.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def allocate(df: DataFrame, keys: list[str], start: str, end: str, step: int = 600) -> DataFrame:
    """Seconds of [start, end) in each step it meets: keys, step, seconds. Bounds are epoch seconds."""
    first = F.col(start) - F.pmod(F.col(start), F.lit(step))
    cut = df.where(F.col(end) > F.col(start)).withColumn("step", F.explode(F.sequence(first, F.col(end) - 1, F.lit(step))))
    inside = F.least(F.col(end), F.col("step") + step) - F.greatest(F.col(start), F.col("step"))
    return cut.groupBy(*keys, "step").agg(F.sum(inside).alias("seconds"))


def regular_grid(df: DataFrame, keys: list[str], order: str, step: int) -> DataFrame:
    """A row for each step from each key's first to its last stamp, anchored at the first; rows off that grid vanish."""
    spans = df.groupBy(*keys).agg(F.min(order).alias("_a"), F.max(order).alias("_b"))
    grid = spans.select(*keys, F.explode(F.sequence("_a", "_b", F.lit(step))).alias(order))
    return grid.join(df, [*keys, order], "left")


def null_run_lengths(df: DataFrame, keys: list[str], order: str, value: str, name: str = "gap") -> DataFrame:
    """Length of the run of nulls that each null belongs to, 0 for other rows."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    held = df.withColumn("_block", F.count(value).over(w))
    size = F.sum(F.col(value).isNull().cast("long")).over(W.partitionBy(*keys, "_block"))
    return held.withColumn(name, F.when(F.col(value).isNull(), size).otherwise(F.lit(0)).cast("long")).drop("_block")


def impute(df: DataFrame, keys: list[str], order: str, value: str, limit: int = 3, forward: bool = False) -> DataFrame:
    """Fills interior runs of at most limit nulls by row position, linearly or with the last value; adds <value>__imputed."""
    rows = W.partitionBy(*keys).orderBy(order)
    # looking ahead is looking back in falling order: a frame to the end is made anew for every row
    falling = W.partitionBy(*keys).orderBy(F.desc(order))
    back, ahead = rows.rowsBetween(W.unboundedPreceding, 0), falling.rowsBetween(W.unboundedPreceding, 0)
    here = F.row_number().over(rows)
    df = null_run_lengths(df, keys, order, value, "_gap").withColumn("_pos", here)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(value).alias("v")))
    df = df.withColumn("_k", known)
    df = df.withColumn("_l", F.last("_k", True).over(back)).withColumn("_r", F.last("_k", True).over(ahead))
    share = (F.col("_pos") - F.col("_l.p")) / (F.col("_r.p") - F.col("_l.p"))
    filler = F.col("_l.v") if forward else F.col("_l.v") + (F.col("_r.v") - F.col("_l.v")) * share
    ok = F.col(value).isNull() & (F.col("_gap") <= limit) & F.col("_l").isNotNull() & (F.lit(forward) | F.col("_r").isNotNull())
    df = df.withColumn(f"{value}__imputed", ok).withColumn(value, F.when(ok, filler).otherwise(F.col(value)))
    return df.drop("_gap", "_pos", "_k", "_l", "_r")


def segments(df: DataFrame, keys: list[str], order: str, present: Column, max_gap: int, name: str = "segment_id") -> DataFrame:
    """Segment of each row: present rows at most max_gap apart share one, rows between them join it, others get -1."""
    w = W.partitionBy(*keys).orderBy(order)
    df = df.withColumn("_t", F.when(present, F.col(order)))
    prior = F.last("_t", True).over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(F.col("_t").isNotNull() & ((F.col("_t") - prior > max_gap) | prior.isNull()), 1).otherwise(0)
    df = df.withColumn("_id", F.sum(fresh).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1)
    mark = F.when(F.col("_t").isNotNull(), F.col("_id"))
    df = df.withColumn("_m", mark)
    back = F.last("_m", True).over(w.rowsBetween(W.unboundedPreceding, 0))
    ahead = F.last("_m", True).over(W.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0))
    df = df.withColumn(name, F.when(back == ahead, back).otherwise(F.lit(-1)).cast("long"))
    return df.drop("_t", "_id", "_m")
