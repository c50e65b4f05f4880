"""Cleaning, stops, events and labels of sensor time-series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import first_of_greatest
from . import islands, temporal

TOLERANCE = 1e-4


def drop_sentinels(df: DataFrame, codes: Mapping[str, Sequence[float]]) -> DataFrame:
    """Values within TOLERANCE of a listed code become null."""
    def clean(c: str) -> Column:
        hit = F.lit(False)
        for code in codes[c]:
            hit = hit | (F.abs(F.col(c) - F.lit(float(code))) <= TOLERANCE)
        return F.when(~hit, F.col(c))

    return df.withColumns({c: clean(c) for c in codes})


def apply_bounds(df: DataFrame, bounds: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Values outside of their inclusive bounds become null."""
    def clean(c: str) -> Column:
        low, high = bounds[c]
        bad = F.lit(False)
        if low is not None:
            bad = bad | (F.col(c) < low)
        if high is not None:
            bad = bad | (F.col(c) > high)
        return F.when(~bad, F.col(c))

    return df.withColumns({c: clean(c) for c in bounds})


def apply_floors(df: DataFrame, floors: Mapping[str, float]) -> DataFrame:
    """Values below a floor are raised to it; nulls stay."""
    return df.withColumns({c: F.when(F.col(c) < f, F.lit(f)).otherwise(F.col(c)) for c, f in floors.items()})


def merged_bounds(defaults: Mapping, overrides: Mapping[str, Mapping], source: str) -> dict:
    return {**defaults, **overrides.get(source, {})}


def mean_duplicates(df: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """One row per key: the mean of each channel without nulls."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in channels])


def first_duplicates(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def repeats(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows with a value, collapsed to one per key (null keys kept): the greatest values, n_rows, and _clash, whether the key's values conflict."""
    some, clash = F.lit(False), F.lit(False)
    for c in values:
        some = some | F.col(c).isNotNull()
        clash = clash | F.coalesce(F.max(c) != F.min(c), F.lit(False))
    return df.where(some).groupBy(*keys).agg(*[F.max(c).alias(c) for c in values], F.count("*").alias("n_rows"), clash.alias("_clash"))


def collapse_repeated(df: DataFrame, keys: list[str], values: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with a value, collapsed to one per key (null keys kept), and the keys whose values conflict."""
    grouped = repeats(df, keys, values)
    return grouped.where("not _clash").drop("_clash"), grouped.where("_clash").drop("_clash")


def spread_check(df: DataFrame, key: str, values: list[str], limit: float = 1e-9) -> DataFrame:
    """Per value column: labels that repeat, and those whose repeated values differ by more than limit."""
    per = df.groupBy(key).agg(
        *[x for c in values for x in (F.count(c).alias(f"n_{c}"), (F.max(c) - F.min(c)).alias(f"s_{c}"))]
    )
    stacked = per.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n"), F.col(f"s_{c}").alias("s")) for c in values])).alias("x"))
    return stacked.groupBy("x.column").agg(F.count_if(F.col("x.n") > 1).alias("repeated"), F.count_if((F.col("x.n") > 1) & (F.col("x.s") > limit)).alias("conflicting"))


def drop_identical(df: DataFrame, keys: list[str], channels: list[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct rows over keys and channels, and keys that still have several."""
    kept = df.dropDuplicates([*keys, *channels])
    return kept, kept.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def present_channels(df: DataFrame, keys: list[str], channels: list[str], share: float) -> DataFrame:
    """Per key: the channels whose non-null share is at least share."""
    tests = [F.when(F.count(c) / F.count("*") >= share, F.lit(c)) for c in channels]
    return df.groupBy(*keys).agg(F.array_compact(F.array(*tests)).alias("channels"))


def drop_short_segments(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of segments with at least least rows; rows outside of segments go."""
    n = F.count("*").over(W.partitionBy(*keys, "segment_id"))
    return df.withColumn("_n", n).where((F.col("segment_id") >= 0) & (F.col("_n") >= least)).drop("_n")


def stop_steps(stops: DataFrame, causes: Sequence[str], step: int = 600) -> DataFrame:
    """turbine, step, total_s and seconds per cause: unions of intervals per cause, and over all causes, dealt to steps."""
    known = stops.where(F.col("cause").isin(*causes))
    by_cause = islands.allocate(islands.interval_union(known, ["turbine", "cause"], "start", "end"), ["turbine", "cause"], "start", "end", step)
    wide = by_cause.groupBy("turbine", "step").pivot("cause", list(causes)).agg(F.sum("seconds")).fillna(0)
    total = islands.allocate(islands.interval_union(known, ["turbine"], "start", "end"), ["turbine"], "start", "end", step)
    return total.withColumnRenamed("seconds", "total_s").join(wide, ["turbine", "step"], "left")


def downtime_steps(downtime: DataFrame, timers: DataFrame, causes: Mapping[str, Sequence[str]], overrides: DataFrame | None = None, step: int = 600) -> DataFrame:
    """Seconds per cause from clipped downtime and its timers; what no timer explains is 'unknown'.

    A timer counts up to the downtime; a cause's timers together up to it too.
    overrides(turbine, step, cause) moves 'technical' seconds to its cause.
    """
    rows = downtime.withColumn("total_s", F.greatest(F.lit(0), F.least(F.lit(step), "downtime_s"))).join(timers, ["turbine", "step"], "left")
    parts = {}
    for cause, names in causes.items():
        each = [F.least(F.greatest(F.coalesce(F.col(n), F.lit(0)), F.lit(0)), F.col("total_s")) for n in names]
        parts[cause] = F.least(sum(each[1:], each[0]), F.col("total_s"))
    rows = rows.withColumns(parts)
    left = F.col("total_s") - sum((F.col(c) for c in list(causes)[1:]), F.col(next(iter(causes))))
    rows = rows.withColumn("unknown", F.greatest(F.lit(0), left))
    if overrides is not None and "technical" in causes:
        rows = rows.join(overrides.withColumnRenamed("cause", "_to"), ["turbine", "step"], "left")
        for cause in causes:
            if cause != "technical":
                rows = rows.withColumn(cause, F.when(F.col("_to") == cause, F.col(cause) + F.col("technical")).otherwise(F.col(cause)))
        rows = rows.withColumn("technical", F.when(F.col("_to").isNotNull(), 0).otherwise(F.col("technical"))).drop("_to")
    return rows


def override_steps(alarms: DataFrame, step: int = 600) -> DataFrame:
    """turbine, step, code of all steps from start to end inclusive; a null end is the start."""
    first = F.col("start") - F.pmod(F.col("start"), F.lit(step))
    return alarms.select("turbine", "code", F.explode(F.sequence(first, F.greatest("start", F.coalesce("end", "start")), F.lit(step))).alias("step")).distinct()


def select_events(steps: DataFrame, causes: Sequence[str], least_s: float, step: int = 600) -> DataFrame:
    """Runs of consecutive steps with seconds of the chosen causes: turbine, start, end, steps, seconds, dominant, first_cause."""
    chosen = sum((F.col(c) for c in causes[1:]), F.col(causes[0]))
    rows = steps.withColumn("seconds", F.least(chosen, F.col("total_s"))).where("seconds > 0")
    rows = islands.runs(rows, ["turbine"], "step", step).withColumn("_first", first_of_greatest(list(causes)))
    grouped = rows.groupBy("turbine", "run").agg(
        F.min("step").alias("start"), (F.max("step") + step).alias("end"), F.count("*").alias("steps"), F.sum("seconds").alias("seconds"),
        F.min_by("_first", "step").alias("first_cause"), *[F.sum(c).alias(c) for c in causes],
    )
    return grouped.withColumn("dominant", first_of_greatest(list(causes))).where(F.col("seconds") >= least_s).drop("run", *causes)


def threshold_runs(df: DataFrame, value: str, least: float, step: int = 600) -> DataFrame:
    """Runs of consecutive steps with value >= least: turbine, start, end, steps, total."""
    rows = islands.runs(df.where(F.col(value) >= least), ["turbine"], "step", step)
    return rows.groupBy("turbine", "run").agg(
        F.min("step").alias("start"), (F.max("step") + step).alias("end"), F.count("*").alias("steps"), F.sum(value).alias("total")
    ).drop("run")


def fault_flag(code: Column, category: Column, codes: Sequence[str], categories: Sequence[str], default: bool | None) -> Column:
    """True on a listed code or category; false if there is something to match and it doesn't; else the default."""
    told = (code.isNotNull() & F.lit(bool(codes))) | (category.isNotNull() & F.lit(bool(categories)))
    return (
        F.when(code.isin(*codes) if codes else F.lit(False), True)
        .when(category.isin(*categories) if categories else F.lit(False), True)
        .when(told, False)
        .otherwise(F.lit(default).cast("boolean"))
    )


def label_steps(steps: DataFrame, starts: DataFrame, horizons: Sequence[int], names: Sequence[str], step: int = 600) -> DataFrame:
    for h, name in zip(horizons, names, strict=True):
        steps = temporal.horizon_labels(steps, starts, ["turbine"], h, name, step)
    return steps
