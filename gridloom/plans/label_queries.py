"""Queries of the label stage: events of three kinds of sources, all durations and horizons in one plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labelling as B
from .registry import HOUR, READ, query, raw, readings, stops
from .series_queries import CAUSES

SETS = {"narrow": ["click"], "broad": CAUSES}
DURATIONS, HORIZONS = [600, 1800, 3600, 9000], [6, 24]
SITE = "CASE turbine % 3 WHEN 0 THEN 'status' WHEN 1 THEN 'downtime' ELSE 'events' END"


def _union(keys: str, name: str) -> str:
    return f"""{name}o AS (SELECT *, max("end") OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s0 WHERE "end" > start),
{name}n AS (SELECT *, sum(CASE WHEN start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM {name}o),
{name}u AS (SELECT {keys}, min(start) AS start, max("end") AS "end" FROM {name}n GROUP BY {keys}, k),
{name} AS (SELECT {keys}, x.step, sum(least("end", x.step + {HOUR}) - greatest(start, x.step))::BIGINT AS seconds FROM {name}u, LATERAL (SELECT unnest(generate_series((start // {HOUR}) * {HOUR}, "end" - 1, {HOUR})) AS step) x GROUP BY ALL)"""


def _runs(name: str, seconds: str) -> str:
    return f"""SELECT source, turbine, '{name}' AS set, min(step) AS start, sum(v)::DOUBLE AS seconds FROM (SELECT *, sum(CASE WHEN step - p <= {HOUR} THEN 0 ELSE 1 END) OVER (PARTITION BY source, turbine ORDER BY step) AS run
 FROM (SELECT *, lag(step) OVER (PARTITION BY source, turbine ORDER BY step) AS p FROM (SELECT source, turbine, step, least({seconds}, total_s) AS v FROM st) WHERE v > 0)) GROUP BY source, turbine, run"""


FLOW = f"""{READ}, s0 AS (SELECT * FROM s WHERE turbine % 3 = 0), {_union("turbine, cause", "ca")}, {_union("turbine", "al")},
d0 AS (SELECT turbine, step, greatest(0, least({HOUR}, floor(sum(value) + 1e-6)::BIGINT * 3)) AS total_s, coalesce(floor(sum(value) FILTER (cause = 'click') + 1e-6), 0)::BIGINT * 2 AS a, coalesce(floor(sum(value) FILTER (cause = 'view') + 1e-6), 0)::BIGINT AS b FROM e WHERE turbine % 3 = 1 GROUP BY 1, 2),
st AS (SELECT 'status' AS source, al.turbine, al.step, al.seconds AS total_s, coalesce(sum(ca.seconds) FILTER (cause = 'click'), 0)::BIGINT AS click, coalesce(sum(ca.seconds), 0)::BIGINT AS allc FROM al LEFT JOIN ca ON ca.turbine = al.turbine AND ca.step = al.step GROUP BY ALL
 UNION ALL SELECT 'downtime', turbine, step, total_s, least(a, total_s), least(a, total_s) + least(b, total_s) FROM d0),
ev AS ({_runs("narrow", "click")} UNION ALL {_runs("broad", "allc")} UNION ALL SELECT 'events', turbine, x.set, start, NULL FROM s, (SELECT unnest(['narrow', 'broad']) AS set) x WHERE turbine % 3 = 2 AND cause = 'error'),
gr AS (SELECT DISTINCT {SITE} AS source, turbine, step, power >= 60 AS has_data FROM g),
du AS (SELECT unnest({[float(d) for d in DURATIONS]}::DOUBLE[]) AS duration), so AS (SELECT unnest(['status', 'downtime', 'events']) AS source), se AS (SELECT unnest(['narrow', 'broad']) AS set)"""


def labelled(T) -> B.Labelled:
    """Thirds of the turbines as a source with stop rows, one with downtime and timers, and one whose errors are events."""
    e, third = raw(T), F.col("turbine") % 3
    down = e.where(third == 1).groupBy("turbine", "step").agg((F.floor(F.sum("value") + 1e-6) * 3).alias("downtime_s"))
    part = lambda c: F.coalesce(F.floor(F.sum(F.when(F.col("cause") == c, F.col("value"))) + 1e-6), F.lit(0))
    timers = e.where(third == 1).groupBy("turbine", "step").agg((part("click") * 2).alias("a"), part("view").alias("b"))
    sources = {
        "status": B.StopSource("status", stops(T).where(third == 0)),
        "downtime": B.StopSource("downtime", downtime=down, timers=timers, timer_causes={"click": ["a"], "view": ["b"]}),
        "events": B.StopSource("events", stops(T).where((third == 2) & (F.col("cause") == "error"))),
    }
    name = F.when(third == 0, "status").when(third == 1, "downtime").otherwise("events")
    grid = readings(T).select(name.alias("source"), "turbine", "step", "power")
    return B.label_sources(sources, grid, SETS, CAUSES, DURATIONS, HORIZONS, HOUR, lambda: F.col("power") >= 60)


@query("label_counts", f"""WITH {FLOW}, k AS (SELECT ev.*, gr.step IS NOT NULL AS inside FROM ev LEFT JOIN gr ON gr.source = ev.source AND gr.turbine = ev.turbine AND gr.step = (ev.start // {HOUR}) * {HOUR})
SELECT source, set, duration, count(k.start) AS events, count(*) FILTER (inside) AS in_grid FROM so CROSS JOIN se CROSS JOIN du LEFT JOIN k ON k.source = so.source AND k.set = se.set AND (k.seconds IS NULL OR k.seconds >= duration) GROUP BY ALL""".replace("SELECT source, set,", "SELECT so.source, se.set,"))
def label_counts(T):
    """Events per source, label set and least duration, and those that begin on the grid."""
    return labelled(T).counts


@query("label_tallies", f"""WITH {FLOW}, ho AS (SELECT unnest({HORIZONS}) AS horizon),
co AS (SELECT a.source, a.turbine, a.step, a.has_data, horizon, count(b.step) >= horizon AS covered FROM gr a CROSS JOIN ho LEFT JOIN gr b ON b.source = a.source AND b.turbine = a.turbine AND b.step > a.step AND b.step <= a.step + horizon * {HOUR} GROUP BY a.source, a.turbine, a.step, a.has_data, horizon),
hi AS (SELECT co.*, se.set, duration, EXISTS (SELECT 1 FROM ev WHERE ev.source = co.source AND ev.turbine = co.turbine AND ev.set = se.set AND (ev.seconds IS NULL OR ev.seconds >= duration) AND ev.start > co.step AND ev.start <= co.step + horizon * {HOUR}) AS hit FROM co CROSS JOIN se CROSS JOIN du)
SELECT source, set, duration, horizon, count(*) AS steps, count(*) FILTER (hit OR covered) AS known, count(*) FILTER (hit) AS positive, count(*) FILTER ((hit OR covered) AND has_data) AS known_with_data, count(*) FILTER (hit AND has_data) AS positive_with_data FROM hi GROUP BY ALL""")
def label_tallies(T):
    """Steps, known and positive labels per source, set, duration and horizon."""
    return labelled(T).tallies


@query("changed_causes", f"""WITH {READ}, c0 AS (SELECT 'as they are' AS change, * FROM s UNION ALL SELECT 'view as click', turbine, start, "end", CASE WHEN cause = 'view' THEN 'click' ELSE cause END FROM s),
o AS (SELECT *, max("end") OVER (PARTITION BY change, turbine ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c0 WHERE "end" > start AND cause = 'click'),
n AS (SELECT *, sum(CASE WHEN start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY change, turbine ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM o),
u AS (SELECT change, turbine, min(start) AS start, max("end") AS "end" FROM n GROUP BY change, turbine, k),
a AS (SELECT change, turbine, x.step, sum(least("end", x.step + {HOUR}) - greatest(start, x.step))::BIGINT AS v FROM u, LATERAL (SELECT unnest(generate_series((start // {HOUR}) * {HOUR}, "end" - 1, {HOUR})) AS step) x GROUP BY ALL),
r AS (SELECT *, sum(CASE WHEN step - p <= {HOUR} THEN 0 ELSE 1 END) OVER (PARTITION BY change, turbine ORDER BY step) AS run FROM (SELECT *, lag(step) OVER (PARTITION BY change, turbine ORDER BY step) AS p FROM a)),
e2 AS (SELECT change, turbine, run, count(*) AS steps, sum(v) AS v FROM r GROUP BY ALL HAVING sum(v) >= 1800)
SELECT CASE change WHEN 'as they are' THEN '' ELSE change END AS change, count(*) AS events, sum(steps)::BIGINT AS steps, sum(v)::BIGINT AS seconds FROM e2 GROUP BY ALL""")
def changed_causes(T):
    """The event rule on click stops, and again with view stops counted as such."""
    moved = {"view as click": lambda df: df.withColumn("cause", F.when(F.col("cause") == "view", "click").otherwise(F.col("cause")))}
    return B.changed_causes(B.StopSource("status", stops(T)), moved, ["click"], CAUSES, 1800, HOUR)
