"""Labels of a whole site: events by source and rule, for all durations and label sets in one plan.

A run of stopped steps is made once per label set, with its seconds. Its level
is the number of durations that it reaches, so events of any duration are runs
of at least a level, and the largest level that begins within a horizon answers
for all durations at once. Steps and run starts of all sets stand in one
order, so labels of all sets, horizons and durations need one exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import telemetry as M
from .tables import written

UNIT = ["source", "turbine"]


@dataclass(frozen=True)
class StopSource:
    """Where a source's stops come from: rows of kind 'status', 'downtime' or 'events'.

    status: stops(turbine, start, end, cause) of provider stop rows. downtime:
    downtime(turbine, step, downtime_s), timers(turbine, step, ...), timer_causes
    from a cause to its timers, and overrides(turbine, step, cause). events:
    stops(turbine, start, end) that are faults as they stand, in all sets.
    """

    kind: str
    stops: DataFrame | None = None
    downtime: DataFrame | None = None
    timers: DataFrame | None = None
    timer_causes: Mapping[str, Sequence[str]] = field(default_factory=dict)
    overrides: DataFrame | None = None


def source_steps(rule: StopSource, causes: Sequence[str], step: int) -> DataFrame | None:
    """turbine, step, total_s and seconds of each cause; None for a source whose events stand as they are."""
    if rule.kind == "status":
        return M.stop_steps(rule.stops, causes, step)
    if rule.kind == "downtime":
        rows = M.downtime_steps(rule.downtime, rule.timers, rule.timer_causes, rule.overrides, step)
        return rows.select("turbine", "step", "total_s", *[F.col(c) if c in rows.columns else F.lit(0).alias(c) for c in causes])
    if rule.kind == "events":
        return None
    raise ValueError(f"no labelling rule of kind {rule.kind!r}")


def level_of(seconds: Column, durations: Sequence[float]) -> Column:
    """How many of the durations, in rising order, are reached."""
    return F.size(F.filter(F.array(*[F.lit(float(d)) for d in durations]), lambda d: d <= seconds))


def source_events(rule: StopSource, sets: Mapping[str, Sequence[str]], causes: Sequence[str], durations: Sequence[float], step: int) -> DataFrame:
    """set, turbine, start, end, steps, seconds, dominant, first_cause, level: all runs of a source, short ones with level 0."""
    steps = source_steps(rule, causes, step)
    found = None
    if steps is not None:
        steps = written(steps, "stops")  # read by each set
    for name, chosen in sets.items():
        if steps is None:
            none = F.lit(None)
            runs = rule.stops.where("start is not null").select(
                "turbine", "start", "end", none.cast("long").alias("steps"), none.cast("double").alias("seconds"), F.lit("unknown").alias("dominant"), F.lit("unknown").alias("first_cause"),
                F.lit(len(durations)).alias("level"),
            )
        else:
            runs = M.select_events(steps, list(chosen), 0, step).withColumn("level", level_of(F.col("seconds"), durations))
            runs = runs.withColumn("seconds", F.col("seconds").cast("double"))
        runs = runs.select(F.lit(name).alias("set"), "turbine", "start", "end", "steps", "seconds", "dominant", "first_cause", "level")
        found = runs if found is None else found.unionByName(runs)
    return found


def step_levels(steps: DataFrame, events: DataFrame, sets: Sequence[str], horizons: Sequence[int], step: int) -> DataFrame:
    """steps(source, turbine, step, covered) with, per set and horizon, the largest level that begins in (step, step + horizon] and whether all of it is covered.

    Columns are <set>_<horizon>_level (0: nothing) and covered_<horizon>. Steps
    of a turbine are there once.
    """
    hits = events.where("level > 0").select(*UNIT, F.col("start").alias("step"), *[F.when(F.col("set") == s, F.col("level")).alias(f"_l_{s}") for s in sets])
    both = steps.withColumn("_row", F.lit(True)).unionByName(hits, allowMissingColumns=True)
    out = {}
    for h in horizons:
        w = W.partitionBy(*UNIT).orderBy("step").rangeBetween(1, h * step)
        out[f"covered_{h}"] = F.coalesce(F.sum(F.when(F.col("covered"), 1)).over(w), F.lit(0)) >= h
        out |= {f"{s}_{h}_level": F.coalesce(F.max(f"_l_{s}").over(w), F.lit(0)) for s in sets}
    return both.withColumns(out).where("_row").drop("_row", *[f"_l_{s}" for s in sets])


def label(levels: str, covered: str, place: int) -> Column:
    """Three-valued label for the duration at a place (from 1 on): true, false, or null where neither is known."""
    return F.when(F.col(levels) >= place, True).when(F.col(covered), False)


@dataclass
class Labelled:
    """What label_sources() returns: events (with in_grid), counts, levels of steps, tallies."""

    events: DataFrame
    counts: DataFrame
    levels: DataFrame
    tallies: DataFrame


def label_sources(
    sources: Mapping[str, StopSource], grid: DataFrame, sets: Mapping[str, Sequence[str]], causes: Sequence[str], durations: Sequence[float], horizons: Sequence[int], step: int = 600,
    has_data: Callable[[], Column] = lambda: F.lit(True),
) -> Labelled:
    """Events and labels of all sources.

    grid(source, turbine, step, and what has_data reads) are the steps that
    evidence covers. counts: source, set, duration, events and those that begin
    in a step of the grid. tallies: source, set, duration, horizon, steps,
    known, positive and these of steps with data. durations are taken in rising
    order; a source without events has counts of nothing and labels that are
    false wherever the horizon is covered.
    """
    durations = sorted(durations)
    found = None
    for name, rule in sources.items():
        rows = source_events(rule, sets, causes, durations, step).select(F.lit(name).alias("source"), "*")
        found = rows if found is None else found.unionByName(rows)
    own = grid.select(*UNIT, "step").distinct().withColumn("in_grid", F.lit(True))
    found = found.withColumn("_s", F.col("start") - F.pmod("start", F.lit(step)))
    events = found.join(own.withColumnRenamed("step", "_s"), [*UNIT, "_s"], "left").withColumn("in_grid", F.coalesce("in_grid", F.lit(False))).drop("_s")
    events = written(events, "events")

    spark = grid.sparkSession
    wanted = [(s, n, k, float(d)) for s in sources for n in sets for k, d in enumerate(durations, 1)]
    frame = spark.createDataFrame(wanted, "source string, set string, place int, duration double")
    reached = events.where("level > 0").select("source", "set", "in_grid", F.explode(F.sequence(F.lit(1), "level")).alias("place"))
    n = reached.groupBy("source", "set", "place").agg(F.count("*").alias("events"), F.count_if("in_grid").alias("in_grid"))
    counts = frame.join(n, ["source", "set", "place"], "left").fillna(0, ["events", "in_grid"]).drop("place")

    rows = grid.select(*UNIT, "step", has_data().alias("has_data"), F.lit(True).alias("covered"))
    levels = written(step_levels(rows, events, list(sets), horizons, step), "labels")
    told = [F.struct(F.lit(s).alias("set"), F.lit(float(d)).alias("duration"), F.lit(h).alias("horizon"), label(f"{s}_{h}_level", f"covered_{h}", k).alias("y")) for s in sets for k, d in enumerate(durations, 1) for h in horizons]
    long = levels.select("source", "has_data", F.inline(F.array(*told)))
    y, data = F.col("y"), F.col("has_data")
    tallies = long.groupBy("source", "set", "duration", "horizon").agg(
        F.count("*").alias("steps"), F.count("y").alias("known"), F.count_if(y).alias("positive"), F.count_if(y.isNotNull() & data).alias("known_with_data"), F.count_if(y & data).alias("positive_with_data")
    )
    return Labelled(events, counts, levels, tallies)


def changed_causes(rule: StopSource, changes: Mapping[str, Callable[[DataFrame], DataFrame]], chosen: Sequence[str], causes: Sequence[str], least_s: float, step: int = 600) -> DataFrame:
    """change, events, steps, seconds of the event rule when a source's stops get other causes; '' is the rule as it stands."""
    found = None
    for name, change in {"": lambda df: df, **changes}.items():
        events = M.select_events(M.stop_steps(change(rule.stops), causes, step), list(chosen), least_s, step)
        row = events.agg(F.count("*").alias("events"), F.coalesce(F.sum("steps"), F.lit(0)).alias("steps"), F.coalesce(F.sum("seconds"), F.lit(0)).alias("seconds"))
        row = row.select(F.lit(name).alias("change"), "*")
        found = row if found is None else found.union(row)
    return found
