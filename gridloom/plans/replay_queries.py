"""Queries of replays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import replay as R
from .registry import HOUR, READ, query, readings
from .series_queries import FAULTS, faults

BASE = f"""{READ}, {FAULTS}, w AS (SELECT turbine, step, round(power / 500, 6) AS p, n > 1 AS label, row_number() OVER (PARTITION BY turbine ORDER BY step) - 1 AS k FROM g),
tr AS (SELECT turbine, step, p, label, p >= 0.3 AS alarm, CASE WHEN nx <= step + 172800 THEN (nx - step) / 3600.0 END AS hours_to_next FROM (SELECT w.*, (SELECT min(start) FROM f WHERE f.turbine = w.turbine AND f.start > w.step) AS nx FROM w WHERE k % 3 = 0))"""


def traced(T):
    w = readings(T).select("turbine", "step", F.round(F.col("power") / 500, 6).alias("p"), (F.col("n") > 1).alias("label"))
    return R.trace(w, faults(T), ["turbine"], "step", "start", 3, 48 * HOUR, 0.3)


@query("replay_trace", f"WITH {BASE} SELECT turbine, step, p, label, alarm, round(hours_to_next, 6) AS hours_to_next FROM tr")
def replay_trace(T):
    return traced(T).withColumn("hours_to_next", F.round("hours_to_next", 6))


@query("trace_summary", f"WITH {BASE} SELECT turbine, count(*) AS windows, count(*) FILTER (label) AS positives, count(*) FILTER (alarm) AS alarms, count(*) FILTER (label AND alarm) AS hits, round(avg(label::INT), 9) AS rate FROM tr GROUP BY 1")
def trace_summary(T):
    return R.trace_summary(traced(T), ["turbine"]).withColumn("rate", F.round("rate", 9))


@query("against_record", f"WITH {BASE}, su AS (SELECT turbine, count(*) FILTER (alarm) AS alarms, avg(p) AS m FROM tr GROUP BY 1) SELECT turbine, 'm' AS \"column\", round(m, 3) AS measured, round(m + CASE WHEN turbine % 5 = 0 THEN 0.01 ELSE 0 END, 3) AS recorded FROM su WHERE round(m, 3) <> round(m + CASE WHEN turbine % 5 = 0 THEN 0.01 ELSE 0 END, 3)")
def against_record(T):
    s = traced(T).groupBy("turbine").agg(F.count_if("alarm").alias("alarms"), F.avg("p").alias("m"))
    kept = s.withColumn("m", F.col("m") + F.when(F.col("turbine") % 5 == 0, 0.01).otherwise(0.0))
    return R.against_record(s, kept, ["turbine"], {"alarms": 0, "m": 3})


@query("step_axis", f"WITH {READ} SELECT turbine, 1 + count(*) FILTER (step - p > 36000) AS pieces, min(step) AS first, max(step) AS last FROM (SELECT turbine, step, lag(step) OVER (PARTITION BY turbine ORDER BY step) AS p FROM g) GROUP BY 1")
def step_axis(T):
    return R.step_axis(readings(T), ["turbine"], "step", 10 * HOUR)


@query("events_inside", f"WITH {READ}, {FAULTS}, su AS (SELECT turbine, min(step) + 864000 AS first, max(step) - 864000 AS last FROM g GROUP BY 1) SELECT turbine, start FROM f JOIN su USING (turbine) WHERE start BETWEEN first AND last + 7200")
def events_inside(T):
    s = R.step_axis(readings(T), ["turbine"], "step", HOUR).select("turbine", (F.col("first") + 864000).alias("first"), (F.col("last") - 864000).alias("last"))
    return R.events_inside(faults(T), s, ["turbine"], "start", 7200)
