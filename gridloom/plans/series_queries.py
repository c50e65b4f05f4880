"""Queries of the time-series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import binning as B
from ..operators import islands as I
from ..operators import profile as P
from ..operators import splits as L
from ..operators import telemetry as M
from ..operators import temporal as J
from .registry import HOUR, READ, query, raw, readings, stops

KEYS = ["turbine", "year"]
CAUSES = ["click", "error", "purchase", "signup", "view"]
#: 2024-01-20 and 2024-01-25, in epoch seconds: ends of the training and validation spans
TRAIN, VAL = 1705708800, 1706140800


@query("clean_rules", f"""WITH {READ} SELECT turbine, step,
CASE WHEN v BETWEEN 10 AND 480 THEN CASE WHEN v < 25 THEN 25.0 ELSE v END END AS power FROM
(SELECT turbine, step, CASE WHEN NOT (abs(power - 100.0) <= 1e-4 OR abs(power - 200.0) <= 1e-4) THEN power END AS v FROM g)""")
def clean_rules(T):
    """Sentinels, inclusive bounds, floors."""
    x = M.drop_sentinels(readings(T).select("turbine", "step", "power"), {"power": [100.0, 200.0]})
    return M.apply_floors(M.apply_bounds(x, M.merged_bounds({"power": (0.0, 1e9)}, {"site": {"power": (10.0, 480.0)}}, "site")), {"power": 25.0})


@query("channel_ranges", f"""WITH {READ} SELECT turbine, count(power) AS n, min(power) AS low, max(power) AS high, round(quantile_cont(power, 0.05), 6) AS p05,
round(quantile_cont(power, 0.5), 6) AS p50, round(quantile_cont(power, 0.95), 6) AS p95, count(*) FILTER (power < 20 OR power > 450) AS out_of_bounds,
count(*) FILTER (abs(power - 100) <= 1e-4) AS sentinels FROM g GROUP BY 1""")
def channel_ranges(T):
    r = P.ranges(readings(T), ["turbine"], "power", (20.0, 450.0), [100.0])
    return r.withColumns({c: F.round(c, 6) for c in ("p05", "p50", "p95")})


@query("mean_duplicates", "SELECT user_id AS turbine, event_type AS cause, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def mean_duplicates(T):
    return M.mean_duplicates(raw(T), ["turbine", "cause"], ["value"]).withColumn("value", F.round("value", 6))


@query("first_duplicates", f"WITH {READ} SELECT turbine, step, value FROM e QUALIFY row_number() OVER (PARTITION BY turbine, step ORDER BY t, value) = 1")
def first_duplicates(T):
    return M.first_duplicates(raw(T), ["turbine", "step"], ["t", "value"]).select("turbine", "step", "value")


@query("collapse_repeated", """SELECT o_custkey, max(o_orderpriority) AS o_orderpriority, count(*) AS n_rows FROM orders GROUP BY 1
HAVING min(o_orderpriority) = max(o_orderpriority)""")
def collapse(T):
    return M.collapse_repeated(T("orders"), ["o_custkey"], ["o_orderpriority"])[0]


@query("collapse_conflicts", "SELECT count(*) AS keys, sum(n)::BIGINT AS n_rows FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING min(o_orderpriority) <> max(o_orderpriority))")
def conflicts(T):
    c = M.collapse_repeated(T("orders"), ["o_custkey"], ["o_orderpriority"])[1]
    return c.agg(F.count("*").alias("keys"), F.sum("n_rows").alias("n_rows"))


@query("repeated_columns", """SELECT "column", count(*) FILTER (n > 1) AS repeated, count(*) FILTER (n > 1 AND s > 1e-9) AS conflicting FROM
(SELECT 'l_quantity' AS "column", count(l_quantity) AS n, max(l_quantity) - min(l_quantity) AS s FROM lineitem GROUP BY l_orderkey
 UNION ALL SELECT 'l_tax', count(l_tax), max(l_tax) - min(l_tax) FROM lineitem GROUP BY l_orderkey) GROUP BY 1""")
def repeated_columns(T):
    return M.spread_check(T("lineitem"), "l_orderkey", ["l_quantity", "l_tax"])


@query("drop_identical", "SELECT count(*) AS kept FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem)")
def identical(T):
    return M.drop_identical(T("lineitem").select("l_orderkey", "l_returnflag", "l_linestatus"), ["l_orderkey"], ["l_returnflag", "l_linestatus"])[0].agg(F.count("*").alias("kept"))


GRID = f"""{READ}, a AS (SELECT turbine, year, min(step) AS lo, max(step) AS hi FROM g GROUP BY 1, 2),
grid AS (SELECT a.turbine, a.year, x.step, g.power FROM a, LATERAL (SELECT unnest(generate_series(lo, hi, 3600)) AS step) x
         LEFT JOIN g ON g.turbine = a.turbine AND g.year = a.year AND g.step = x.step)"""


def grid(T):
    return I.regular_grid(readings(T).select(*KEYS, "step", "power"), KEYS, "step", HOUR)


@query("regular_grid", f"WITH {GRID} SELECT turbine, year, count(*) AS steps, count(power) AS present, sum(step)::BIGINT AS checksum FROM grid GROUP BY 1, 2")
def regular_grid(T):
    return grid(T).groupBy(*KEYS).agg(F.count("*").alias("steps"), F.count("power").alias("present"), F.sum("step").alias("checksum"))


NULLS = f"{GRID}, b AS (SELECT *, count(power) OVER (PARTITION BY turbine, year ORDER BY step) AS blk FROM grid), q AS (SELECT *, count(*) FILTER (power IS NULL) OVER (PARTITION BY turbine, year, blk) AS len FROM b)"


@query("gap_lengths", f"WITH {NULLS} SELECT len AS gap, count(*) AS n FROM q WHERE power IS NULL GROUP BY 1")
def gap_lengths(T):
    g = I.null_run_lengths(grid(T), KEYS, "step", "power").where("power is null")
    return g.groupBy("gap").agg(F.count("*").alias("n"))


@query("impute_linear", f"""WITH {NULLS}, z AS (SELECT *, row_number() OVER w AS p,
 last_value(CASE WHEN power IS NOT NULL THEN step END IGNORE NULLS) OVER (PARTITION BY turbine, year ORDER BY step) AS ls,
 last_value(power IGNORE NULLS) OVER (PARTITION BY turbine, year ORDER BY step) AS lv,
 first_value(CASE WHEN power IS NOT NULL THEN step END IGNORE NULLS) OVER (PARTITION BY turbine, year ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rs,
 first_value(power IGNORE NULLS) OVER (PARTITION BY turbine, year ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rv
 FROM q WINDOW w AS (PARTITION BY turbine, year ORDER BY step))
SELECT turbine, step, round(lv + (rv - lv) * (step - ls) / (rs - ls), 6) AS power FROM z WHERE power IS NULL AND len <= 3 AND ls IS NOT NULL AND rs IS NOT NULL""")
def impute_linear(T):
    x = I.impute(grid(T), KEYS, "step", "power", 3).where("power__imputed")
    return x.select("turbine", "step", F.round("power", 6).alias("power"))


@query("impute_forward", f"""WITH {NULLS} SELECT turbine, count(*) AS filled, round(sum(lv), 4) AS total FROM
(SELECT *, last_value(power IGNORE NULLS) OVER (PARTITION BY turbine, year ORDER BY step) AS lv FROM q) WHERE power IS NULL AND len <= 3 AND lv IS NOT NULL GROUP BY 1""")
def impute_forward(T):
    x = I.impute(grid(T), KEYS, "step", "power", 3, forward=True).where("power__imputed")
    return x.groupBy("turbine").agg(F.count("*").alias("filled"), F.round(F.sum("power"), 4).alias("total"))


SEG = f"""{READ}, i AS (SELECT turbine, year, step, power, sum(CASE WHEN step - p <= 21600 THEN 0 ELSE 1 END) OVER (PARTITION BY turbine, year ORDER BY step) - 1 AS segment_id
FROM (SELECT *, lag(step) OVER (PARTITION BY turbine, year ORDER BY step) AS p FROM g))"""


def segmented(T):
    return I.segments(readings(T), KEYS, "step", F.col("power").isNotNull(), 6 * HOUR)


@query("segments", f"WITH {SEG} SELECT turbine, year, segment_id::BIGINT AS segment_id, count(*) AS n, min(step) AS first, max(step) AS last FROM i GROUP BY 1, 2, 3")
def segments(T):
    return segmented(T).groupBy(*KEYS, "segment_id").agg(F.count("*").alias("n"), F.min("step").alias("first"), F.max("step").alias("last"))


@query("grid_segments", f"""WITH {GRID}, m AS (SELECT *, CASE WHEN power IS NOT NULL THEN sum(CASE WHEN power IS NOT NULL AND (pp IS NULL OR step - pp > 21600) THEN 1 ELSE 0 END) OVER (PARTITION BY turbine, year ORDER BY step) - 1 END AS id FROM
(SELECT *, last_value(CASE WHEN power IS NOT NULL THEN step END IGNORE NULLS) OVER (PARTITION BY turbine, year ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pp FROM grid)),
k AS (SELECT *, last_value(id IGNORE NULLS) OVER (PARTITION BY turbine, year ORDER BY step) AS bk,
 first_value(id IGNORE NULLS) OVER (PARTITION BY turbine, year ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fw FROM m)
SELECT turbine, CASE WHEN bk = fw THEN bk ELSE -1 END::BIGINT AS segment_id, count(*) AS n FROM k GROUP BY 1, 2""")
def grid_segments(T):
    s = I.segments(grid(T), KEYS, "step", F.col("power").isNotNull(), 6 * HOUR)
    return s.groupBy("turbine", "segment_id").agg(F.count("*").alias("n"))


@query("drop_short_segments", f"WITH {SEG} SELECT turbine, step FROM i QUALIFY count(*) OVER (PARTITION BY turbine, year, segment_id) >= 3")
def short_segments(T):
    return M.drop_short_segments(segmented(T), KEYS, 3).select("turbine", "step")


UNION = """o AS (SELECT *, max("end") OVER (PARTITION BY turbine ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s WHERE "end" > start),
n AS (SELECT *, sum(CASE WHEN start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY turbine ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM o),
un AS (SELECT turbine, min(start) AS start, max("end") AS "end" FROM n GROUP BY turbine, k)"""


@query("interval_union", f'WITH {READ}, {UNION} SELECT * FROM un')
def interval_union(T):
    return I.interval_union(stops(T), ["turbine"], "start", "end")


ALLOC = """al AS (SELECT turbine, x.step, sum(least("end", x.step + 600) - greatest(start, x.step))::BIGINT AS seconds FROM un,
LATERAL (SELECT unnest(generate_series((start // 600) * 600, "end" - 1, 600)) AS step) x GROUP BY 1, 2)"""


@query("allocate_steps", f"WITH {READ}, {UNION}, {ALLOC} SELECT * FROM al")
def allocate(T):
    return I.allocate(I.interval_union(stops(T), ["turbine"], "start", "end"), ["turbine"], "start", "end")


CAUSE_STEPS = f"""{READ}, {UNION}, {ALLOC},
co AS (SELECT *, max("end") OVER (PARTITION BY turbine, cause ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s WHERE "end" > start),
cn AS (SELECT *, sum(CASE WHEN start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY turbine, cause ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM co),
cu AS (SELECT turbine, cause, min(start) AS start, max("end") AS "end" FROM cn GROUP BY turbine, cause, k),
ca AS (SELECT turbine, cause, x.step, sum(least("end", x.step + 600) - greatest(start, x.step))::BIGINT AS seconds FROM cu,
       LATERAL (SELECT unnest(generate_series((start // 600) * 600, "end" - 1, 600)) AS step) x GROUP BY 1, 2, 3),
st AS (SELECT al.turbine, al.step, al.seconds AS total_s, {", ".join(f"coalesce(sum(ca.seconds) FILTER (cause = '{c}'), 0)::BIGINT AS {c}" for c in CAUSES)}
       FROM al LEFT JOIN ca ON ca.turbine = al.turbine AND ca.step = al.step GROUP BY 1, 2, 3)"""


@query("stop_steps", f"WITH {CAUSE_STEPS} SELECT * FROM st")
def stop_steps(T):
    return M.stop_steps(stops(T), CAUSES)


ARG = "CASE " + " ".join(f"WHEN {c} = greatest({', '.join(CAUSES)}) THEN '{c}'" for c in CAUSES) + " END"
EVENTS = f"""{CAUSE_STEPS}, rw AS (SELECT *, least({" + ".join(CAUSES)}, total_s) AS seconds, {ARG} AS fc FROM st WHERE total_s > 0 AND {" + ".join(CAUSES)} > 0),
rn AS (SELECT *, sum(CASE WHEN step - p <= 600 THEN 0 ELSE 1 END) OVER (PARTITION BY turbine ORDER BY step) AS run FROM (SELECT *, lag(step) OVER (PARTITION BY turbine ORDER BY step) AS p FROM rw)),
ev AS (SELECT turbine, min(step) AS start, max(step) + 600 AS "end", count(*) AS steps, sum(seconds)::BIGINT AS seconds, arg_min(fc, step) AS first_cause, {", ".join(f"sum({c}) AS {c}" for c in CAUSES)} FROM rn GROUP BY turbine, run)"""


def found_events(T):
    return M.select_events(M.stop_steps(stops(T), CAUSES), CAUSES, 1800)


@query("stop_events", f'WITH {EVENTS} SELECT turbine, start, "end", steps, seconds, first_cause, {ARG} AS dominant FROM ev WHERE seconds >= 1800')
def stop_events(T):
    """The event rule on stop steps: runs, least duration, dominant and first cause."""
    return found_events(T)


@query("threshold_runs", f"""WITH {READ}, r AS (SELECT *, sum(CASE WHEN step - p <= 3600 THEN 0 ELSE 1 END) OVER (PARTITION BY turbine ORDER BY step) AS run FROM
(SELECT *, lag(step) OVER (PARTITION BY turbine ORDER BY step) AS p FROM g WHERE power >= 100))
SELECT turbine, min(step) AS start, max(step) + 3600 AS "end", count(*) AS steps, round(sum(power), 4) AS total FROM r GROUP BY turbine, run""")
def threshold_runs(T):
    return M.threshold_runs(readings(T), "power", 100.0, HOUR).withColumn("total", F.round("total", 4))


@query("override_steps", f"""WITH {READ} SELECT DISTINCT turbine, cause AS code, unnest(generate_series((start // 600) * 600, "end", 600)) AS step FROM s WHERE cause = 'error'""")
def override_steps(T):
    return M.override_steps(stops(T).where("cause = 'error'").withColumnRenamed("cause", "code"))


@query("downtime_causes", f"""WITH {READ}, d AS (SELECT turbine, step, greatest(0, least(3600, floor(sum(value) + 1e-6)::BIGINT * 3)) AS total_s FROM e GROUP BY 1, 2),
m AS (SELECT turbine, step, coalesce(floor(sum(value) FILTER (cause = 'click') + 1e-6), 0)::BIGINT * 2 AS a, coalesce(floor(sum(value) FILTER (cause = 'view') + 1e-6), 0)::BIGINT AS b FROM e GROUP BY 1, 2)
SELECT turbine, step, total_s, least(least(a, total_s), total_s) AS technical, least(least(b, total_s), total_s) AS environmental,
greatest(0, total_s - least(a, total_s) - least(b, total_s)) AS unknown FROM d JOIN m USING (turbine, step)""")
def downtime_causes(T):
    e = raw(T)
    down = e.groupBy("turbine", "step").agg((F.floor(F.sum("value") + 1e-6) * 3).alias("downtime_s"))
    part = lambda c: F.coalesce(F.floor(F.sum(F.when(F.col("cause") == c, F.col("value"))) + 1e-6), F.lit(0))
    timers = e.groupBy("turbine", "step").agg((part("click") * 2).alias("a"), part("view").alias("b"))
    out = M.downtime_steps(down, timers, {"technical": ["a"], "environmental": ["b"]}, step=HOUR)
    return out.select("turbine", "step", "total_s", "technical", "environmental", "unknown")


FAULTS = "f AS (SELECT turbine, t AS start FROM e WHERE cause = 'error')"


def faults(T):
    return raw(T).where("cause = 'error'").select("turbine", F.col("t").alias("start"))


@query("horizon_labels", f"""WITH {GRID}, {FAULTS}, u AS (SELECT turbine, step, 0 AS hit, 1 AS cov FROM grid UNION ALL SELECT turbine, start, 1, 0 FROM f),
l AS (SELECT *, coalesce(sum(hit) OVER w, 0) AS h, coalesce(sum(cov) OVER w, 0) AS c FROM u WINDOW w AS (PARTITION BY turbine ORDER BY step RANGE BETWEEN 1 FOLLOWING AND 86400 FOLLOWING))
SELECT turbine, step, CASE WHEN h > 0 THEN true WHEN c >= 24 THEN false END AS fault_within_24h FROM l WHERE cov = 1""")
def horizon_labels(T):
    """Three-valued forward labels: hit, covered, unknown."""
    return M.label_steps(grid(T).select("turbine", "step"), faults(T), [24], [S.horizon_name("fault", 24, HOUR)], HOUR)


@query("label_tally", f"""WITH {GRID}, {FAULTS}, u AS (SELECT turbine, step, 0 AS hit, 1 AS cov FROM grid UNION ALL SELECT turbine, start, 1, 0 FROM f),
l AS (SELECT *, coalesce(sum(hit) OVER w, 0) AS h, coalesce(sum(cov) OVER w, 0) AS c FROM u WINDOW w AS (PARTITION BY turbine ORDER BY step RANGE BETWEEN 1 FOLLOWING AND 21600 FOLLOWING))
SELECT CASE WHEN step <= {TRAIN} THEN 'train' WHEN step <= {VAL} THEN 'val' ELSE 'test' END AS split, count(*) AS n, count(*) FILTER (h > 0 OR c >= 6) AS known, count(*) FILTER (h > 0) AS positive FROM l WHERE cov = 1 GROUP BY 1""")
def label_tally(T):
    x = M.label_steps(grid(T).select("turbine", "step"), faults(T), [6], ["y"], HOUR)
    x = x.withColumn("split", L.time_split(F.col("step"), TRAIN, VAL))
    return x.groupBy("split").agg(F.count("*").alias("n"), F.count("y").alias("known"), F.count_if(F.col("y")).alias("positive"))


@query("asof_backward", f"WITH {READ}, {FAULTS} SELECT g.turbine, g.step, f.start AS last_fault FROM g ASOF LEFT JOIN f ON g.turbine = f.turbine AND g.step >= f.start")
def asof_backward(T):
    return J.asof_backward(readings(T).select("turbine", "step"), faults(T), ["turbine"], "step", "start", "last_fault")


@query("asof_forward", f"WITH {READ}, {FAULTS} SELECT g.turbine, g.step, CASE WHEN f.start <= g.step + 172800 THEN f.start END AS next_fault FROM g ASOF LEFT JOIN f ON g.turbine = f.turbine AND g.step < f.start")
def asof_forward(T):
    return J.asof_forward(readings(T).select("turbine", "step"), faults(T), ["turbine"], "step", "start", "next_fault", 172800)


@query("hours_since_last", f"WITH {READ}, {FAULTS} SELECT g.turbine, g.step, CASE WHEN f.start IS NOT NULL THEN round(least((g.step - f.start) / 3600, 72), 6) END AS hours FROM g ASOF LEFT JOIN f ON g.turbine = f.turbine AND g.step >= f.start")
def hours_since(T):
    x = J.asof_backward(readings(T).select("turbine", "step"), faults(T), ["turbine"], "step", "start", "at")
    hours = F.when(F.col("at").isNotNull(), F.least((F.col("step") - F.col("at")) / 3600, F.lit(72.0)))
    return x.select("turbine", "step", F.round(hours, 6).alias("hours"))


@query("exists_behind", f"WITH {READ}, {FAULTS} SELECT turbine, step, EXISTS (SELECT 1 FROM f WHERE f.turbine = g.turbine AND f.start > g.step - 86400 AND f.start <= g.step) AS recent FROM g")
def exists_behind(T):
    return J.exists_behind(readings(T).select("turbine", "step"), faults(T), ["turbine"], "step", "start", 86400, "recent")


@query("exists_ahead", f"WITH {READ}, {FAULTS} SELECT turbine, step, EXISTS (SELECT 1 FROM f WHERE f.turbine = g.turbine AND f.start > g.step AND f.start <= g.step + 43200) AS soon FROM g")
def exists_ahead(T):
    return J.exists_ahead(readings(T).select("turbine", "step"), faults(T), ["turbine"], "step", "start", 43200, "soon")


@query("overlap_join", f"""WITH {READ} SELECT a.turbine, a.start, a."end", b.start AS start2, b."end" AS end2 FROM s a JOIN s b ON a.turbine = b.turbine
AND a.start < b."end" AND b.start < a."end" AND a.cause = 'error' AND b.cause = 'view' AND a."end" > a.start AND b."end" > b.start""")
def overlap_join(T):
    x = stops(T)
    return J.overlap_join(x.where("cause = 'error'").drop("cause"), x.where("cause = 'view'").drop("cause"), ["turbine"], 21600)


@query("event_set_agreement", f"""WITH {READ}, a AS (SELECT DISTINCT turbine, start, "end" FROM s WHERE cause = 'error' AND "end" > start), b AS (SELECT DISTINCT turbine, start - 600 AS start, "end" FROM s WHERE cause <> 'view' AND "end" > start - 600)
SELECT (SELECT count(*) FROM a) AS events, (SELECT count(*) FROM a SEMI JOIN b USING (turbine, start, "end")) AS exact,
(SELECT count(*) FROM (SELECT DISTINCT a.turbine, a.start, a."end" FROM a JOIN b ON a.turbine = b.turbine AND a.start < b."end" AND b.start < a."end")) AS touched""")
def event_sets(T):
    x = stops(T)
    a = x.where("cause = 'error'").where(F.col("end") > F.col("start")).select("turbine", "start", "end").distinct()
    b = x.where("cause <> 'view'").select("turbine", (F.col("start") - 600).alias("start"), "end").where(F.col("end") > F.col("start")).distinct()
    exact = a.join(b, ["turbine", "start", "end"], "left_semi").agg(F.count("*").alias("exact"))
    touched = J.overlap_join(a, b, ["turbine"], 21600).select("turbine", "start", "end").distinct().agg(F.count("*").alias("touched"))
    return a.agg(F.count("*").alias("events")).join(F.broadcast(exact)).join(F.broadcast(touched))


@query("opening_messages", f"""WITH {READ}, {FAULTS}, v AS (SELECT DISTINCT turbine, start FROM f), m AS (SELECT turbine, t AS q, cause AS message FROM e WHERE cause <> 'error')
SELECT v.turbine, v.start, coalesce(
 (SELECT min(lpad(q::VARCHAR, 12, '0') || message)[13:] FROM m WHERE m.turbine = v.turbine AND q >= start AND q < start + 600),
 (SELECT max(lpad(q::VARCHAR, 12, '0') || message)[13:] FROM m WHERE m.turbine = v.turbine AND q < start)) AS opening FROM v""")
def opening(T):
    e = raw(T).where("cause <> 'error'").select("turbine", F.col("t").alias("at"), F.col("cause").alias("message"))
    return J.opening_message(faults(T).distinct(), e, ["turbine"])


@query("attach_steps", f"""WITH {READ}, c AS (SELECT turbine, cause, t, CASE WHEN epoch_us(ts) % 3600000000 = 0 THEN epoch_us(ts) // 1000000 ELSE (epoch_us(ts) // 3600000000 + 1) * 3600 END AS up
FROM (SELECT user_id AS turbine, event_type AS cause, epoch_us(ts) // 1000000 AS t, ts FROM events))
SELECT c.turbine, c.cause, count(*) AS n, count(g.step) AS attached FROM c LEFT JOIN g ON g.turbine = c.turbine AND g.step = c.up GROUP BY 1, 2""")
def attach(T):
    """Messages to the next step by equality after rounding up; -1 would be no step."""
    e = T("events").select(F.col("user_id").alias("turbine"), F.col("event_type").alias("cause"), S.step_ceil(F.col("ts"), HOUR).alias("up"))
    g = readings(T).select("turbine", F.col("step").alias("up"), F.lit(1).alias("hit"))
    return e.join(g, ["turbine", "up"], "left").groupBy("turbine", "cause").agg(F.count("*").alias("n"), F.count("hit").alias("attached"))


SPLIT = f"CASE WHEN turbine % 10 = 3 THEN 'evaluation' WHEN turbine % 10 = 7 THEN 'holdout' WHEN step <= {TRAIN} THEN 'train' WHEN step <= {VAL} THEN 'val' ELSE 'test' END"


@query("assign_splits", f"WITH {READ} SELECT {SPLIT} AS split, count(*) AS n FROM g GROUP BY 1")
def assign_splits(T):
    g = readings(T)
    digit = (F.col("turbine") % 10).cast("string")
    return g.groupBy(L.assign_split(F.col("step"), digit, digit, TRAIN, VAL, ["7"], ["3"]).alias("split")).agg(F.count("*").alias("n"))


@query("exclusion_reads", f"""WITH {READ} SELECT turbine, step, source = 'a' AND step BETWEEN {TRAIN - 400000} AND {TRAIN - 300000} AS inside,
source = 'a' AND step <= {TRAIN} AND step >= {TRAIN - 400000} AND step - 5 * 3600 <= {TRAIN - 300000} AS reads FROM (SELECT *, CASE WHEN turbine % 2 = 0 THEN 'a' ELSE 'b' END AS source FROM g)""")
def exclusions(T):
    g = readings(T).withColumn("source", F.when(F.col("turbine") % 2 == 0, "a").otherwise("b")).withColumn("split", L.time_split(F.col("step"), TRAIN, VAL))
    spans = [("a", TRAIN - 400000, TRAIN - 300000)]
    return g.select("turbine", "step", L.in_spans(F.col("source"), F.col("step"), spans).alias("inside"), L.reads_spans(F.col("source"), F.col("split"), F.col("step"), spans, 6, HOUR).alias("reads"))


WINDOWS = f"""{GRID}, sp AS (SELECT *, CASE WHEN step <= {TRAIN} THEN 'train' WHEN step <= {VAL} THEN 'val' ELSE 'test' END AS split FROM grid),
sg AS (SELECT *, sum(CASE WHEN split = ps THEN 0 ELSE 1 END) OVER (PARTITION BY turbine, year ORDER BY step) - 1 AS segment_id FROM (SELECT *, lag(split) OVER (PARTITION BY turbine, year ORDER BY step) AS ps FROM sp)),
we AS (SELECT * FROM (SELECT *, min(step) OVER (PARTITION BY turbine, year, segment_id) AS lo FROM sg) WHERE step - lo >= 23 * 3600 AND (step // 3600) % 6 = 0
 AND step + 12 * 3600 <= CASE split WHEN 'train' THEN {TRAIN} WHEN 'val' THEN {VAL} ELSE 9000000000 END)"""


def window_index(T):
    x = grid(T).withColumn("split", L.time_split(F.col("step"), TRAIN, VAL)).withColumn("segment_id", F.lit(0).cast("long"))
    return L.window_ends(L.cut_segments(x, KEYS), KEYS, 24, 6, 12, TRAIN, VAL, HOUR)


@query("window_ends", f"WITH {WINDOWS} SELECT turbine, step, split, segment_id::BIGINT AS segment_id FROM we")
def window_ends(T):
    return window_index(T).select("turbine", "step", "split", "segment_id")


LEAK = "{0} <> " + "CASE WHEN step - 23 * 3600 <= {TRAIN} THEN 'train' WHEN step - 23 * 3600 <= {VAL} THEN 'val' ELSE 'test' END OR {0} <> CASE WHEN step + 12 * 3600 <= {TRAIN} THEN 'train' WHEN step + 12 * 3600 <= {VAL} THEN 'val' ELSE 'test' END".replace("{TRAIN}", str(TRAIN)).replace("{VAL}", str(VAL))


@query("leakage_checks", f"""WITH {WINDOWS}, nv AS (SELECT * FROM sp WHERE (step // 3600) % 6 = 0), ns AS (SELECT turbine, year, count(DISTINCT split) AS n FROM sp GROUP BY 1, 2)
SELECT 'admitted' AS kind, count(*) AS windows, count(*) FILTER ({LEAK.format("split")}) AS leaking_windows, (SELECT count(*) FROM (SELECT turbine, year, segment_id FROM sg GROUP BY 1, 2, 3 HAVING count(DISTINCT split) > 1)) AS leaking_segments FROM we
UNION ALL SELECT 'all', count(*), count(*) FILTER ({LEAK.format("split")}), (SELECT count(*) FROM ns WHERE n > 1) FROM nv""")
def leakage(T):
    """Windows and segments that read over a change of split: none of the admitted ones, many where nothing is cut."""
    whole = grid(T).withColumn("split", L.time_split(F.col("step"), TRAIN, VAL)).withColumn("segment_id", F.lit(0))
    every = whole.where(F.expr("step div 3600") % 6 == 0)
    out = None
    for kind, windows, rows in (("admitted", window_index(T), L.cut_segments(whole, KEYS)), ("all", every, whole)):
        bad = L.leaking_windows(windows, 24, 12, TRAIN, VAL, HOUR).agg(F.count("*").alias("leaking_windows"))
        seg = L.leaking_segments(rows, KEYS).agg(F.count("*").alias("leaking_segments"))
        some = windows.agg(F.lit(kind).alias("kind"), F.count("*").alias("windows")).join(F.broadcast(bad)).join(F.broadcast(seg))
        out = some if out is None else out.unionByName(some)
    return out


@query("every_kth_window", f"WITH {WINDOWS} SELECT turbine, step FROM we QUALIFY (row_number() OVER (PARTITION BY turbine, year ORDER BY step) - 1) % 4 = 0")
def kth(T):
    return L.every_kth(window_index(T), KEYS, ["step"], 4).select("turbine", "step")


@query("window_blocks", f"WITH {WINDOWS} SELECT split, step // 86400 AS day, count(*) AS windows, count(DISTINCT turbine) AS turbines FROM we GROUP BY 1, 2")
def blocks(T):
    return window_index(T).groupBy("split", F.expr("step div 86400").alias("day")).agg(F.count("*").alias("windows"), F.count_distinct("turbine").alias("turbines"))


@query("channel_coverage", f"WITH {GRID} SELECT turbine, year, round(avg((power IS NOT NULL)::INT), 9) AS power FROM grid GROUP BY 1, 2")
def channel_coverage(T):
    return P.coverage(grid(T), KEYS, ["power"]).withColumn("power", F.round("power", 9))


@query("present_channels", f"WITH {GRID} SELECT turbine, year, CASE WHEN count(power) / count(*) >= 0.09 THEN 'power' ELSE '' END AS channels FROM grid GROUP BY 1, 2")
def present_channels(T):
    return M.present_channels(grid(T), KEYS, ["power"], 0.09).select(*KEYS, F.array_join("channels", ",").alias("channels"))


@query("gap_histogram", f"WITH {READ} SELECT gap, count(*) AS n FROM (SELECT (step - lag(step) OVER (PARTITION BY turbine ORDER BY step)) // 3600 - 1 AS gap FROM g) WHERE gap > 0 GROUP BY 1")
def gap_histogram(T):
    return P.gap_histogram(readings(T), ["turbine"], "step", HOUR)


@query("onset_profile", f"WITH {READ} SELECT ((t // 86400 + 3) % 7)::INT AS weekday, ((t % 86400) // 3600)::INT AS hour, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM e WHERE cause = 'error' GROUP BY 1, 2")
def onset(T):
    return P.onset_profile(raw(T).where("cause = 'error'"), "t").withColumn("share", F.round("share", 9))


@query("duration_shares", f"""WITH {READ} SELECT ((d >= 600)::INT + (d >= 3600)::INT + (d >= 7200)::INT) AS bucket, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM (SELECT "end" - start AS d FROM s) GROUP BY 1""")
def durations(T):
    return P.bucket_shares(stops(T).withColumn("d", F.col("end") - F.col("start")), "d", [600, 3600, 7200]).withColumn("share", F.round("share", 9))


@query("event_summary", "SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS codes, count(DISTINCT props) FILTER (props <> '') AS messages, round(avg((props <> '')::INT), 9) AS free_text_share FROM events GROUP BY 1")
def event_summary(T):
    x = P.event_summary(T("events"), ["event_type"], F.col("user_id"), F.col("props"))
    return x.withColumn("free_text_share", F.round("free_text_share", 9))


@query("json_key_sets", "SELECT array_to_string(list_sort(json_keys(props)), ',') AS keys, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types, count(*) AS n FROM events GROUP BY 1")
def json_keys(T):
    return P.key_sets(T("events"), "props", F.col("event_type"), "types")


@query("clock_fingerprint", f"WITH {READ} SELECT turbine, count(*) FILTER (step >= {TRAIN} AND step < {TRAIN + 86400}) AS in_missing_hour, (count(*) FILTER (step >= {VAL} AND step < {VAL + 86400}) - count(DISTINCT step) FILTER (step >= {VAL} AND step < {VAL + 86400}))::BIGINT AS repeated FROM e GROUP BY 1")
def clock(T):
    return P.clock_fingerprint(raw(T), ["turbine"], "step", (TRAIN, TRAIN + 86400), (VAL, VAL + 86400))


@query("top_messages", "SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 9) AS share FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3")
def top_messages(T):
    """The three most frequent types, ties by name."""
    return P.top_values(T("events"), "event_type", 3).withColumn("share", F.round("share", 9))


@query("percentile_summary", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS low, round(quantile_cont(value, 0.5), 6) AS median, max(value) AS high FROM events GROUP BY 1")
def percentile_summary(T):
    return P.percentile_summary(T("events"), ["event_type"], "value").withColumns({c: F.round(c, 6) for c in ("mean", "std", "median")})


EDGES = "(SELECT list_sort(list_distinct(quantile_cont(value, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]))) FROM events)"


@query("quantile_bins", f"SELECT len(list_filter({EDGES}, lambda x: x <= value)) AS bin, count(*) AS n, round(avg(value), 6) AS rep FROM events GROUP BY 1")
def quantile_bins(T):
    e = T("events").select("value")
    binned = e.join(F.broadcast(B.fit_edges(e, "value", 8))).withColumn("bin", B.bin_of(F.col("value"), F.col("edges")).cast("long"))
    return B.representatives(binned, "value", "bin").withColumn("rep", F.round("rep", 6))


@query("quantile_bins_by_type", """WITH q AS (SELECT event_type, list_sort(list_distinct(quantile_cont(value, [0.25, 0.5, 0.75]))) AS edges FROM events GROUP BY 1)
SELECT event_type, len(list_filter(edges, lambda x: x <= value)) AS bin, count(*) AS n FROM events JOIN q USING (event_type) GROUP BY 1, 2""")
def bins_by_type(T):
    e = T("events").select("event_type", "value")
    binned = e.join(B.fit_edges(e, "value", 4, ["event_type"]), "event_type")
    return binned.groupBy("event_type", B.bin_of(F.col("value"), F.col("edges")).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("point_masses", "SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= (SELECT count(*) FROM lineitem) / 60.0 ORDER BY n DESC, l_quantity LIMIT 15")
def point_masses(T):
    return B.point_masses(T("lineitem").select("l_quantity"), "l_quantity", 60)


@query("reconstruction_error", f"""WITH b AS (SELECT value, len(list_filter({EDGES}, lambda x: x <= value)) AS bin FROM events), r AS (SELECT bin, avg(value) AS rep FROM b GROUP BY 1)
SELECT count(*) AS n, round(avg(abs(value - rep)), 6) AS error FROM b JOIN r USING (bin)""")
def reconstruction(T):
    e = T("events").select("value")
    b = e.join(F.broadcast(B.fit_edges(e, "value", 8))).select("value", B.bin_of(F.col("value"), F.col("edges")).alias("bin"))
    return b.join(F.broadcast(B.representatives(b, "value", "bin").drop("n")), "bin").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("value") - F.col("rep"))), 6).alias("error"))


@query("encode_steps", f"WITH {READ} SELECT turbine, step, '1,' || CASE WHEN power IS NULL THEN 2 ELSE 96 + floor(power / 10)::INT END || ',2' AS tokens FROM g")
def encode_steps(T):
    ids = B.encode_step([F.floor(F.col("power") / 10).cast("int"), F.lit(0)], masked=[1])
    return readings(T).select("turbine", "step", F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("tokens"))


@query("joint_ids", """SELECT id, CASE WHEN id < 32 THEN 'special' WHEN id < 96 THEN 'channel' WHEN id < 1120 THEN 'bin' WHEN id < 1184 THEN 'time' WHEN id < 33952 THEN 'text' END AS block,
CASE WHEN id < 32 THEN id WHEN id < 96 THEN id - 32 WHEN id < 1120 THEN id - 96 WHEN id < 1184 THEN id - 1120 WHEN id < 33952 THEN id - 1184 END AS local
FROM (SELECT (p_partkey * 17)::INT AS id FROM part)""")
def joint_ids(T):
    x = T("part").select((F.col("p_partkey") * 17).cast("int").alias("id"))
    block, local = B.decode_id(F.col("id"))
    return x.select("id", block.alias("block"), local.alias("local"))


STREAM = """i AS (SELECT conv_id, turn // 2 AS step, turn, role, length(text) AS n FROM conversations), st AS (SELECT conv_id, step, count(*) FILTER (turn % 2 = 0) AS a, sum(CASE WHEN turn % 2 = 1 THEN 2 ELSE 0 END) AS b FROM i GROUP BY 1, 2 HAVING count(*) FILTER (turn % 2 = 0) > 0),
so AS (SELECT conv_id, step, (1 + b)::BIGINT AS size, coalesce(sum(1 + b) OVER (PARTITION BY conv_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM st)"""


def stream(T):
    c = T("conversations").select("conv_id", "turn", F.expr("turn div 2").alias("step"))
    steps = c.where("turn % 2 = 0").select("conv_id", "step", F.array(F.lit(1)).alias("tokens"))
    said = c.where("turn % 2 = 1").select("conv_id", "step", F.col("turn").alias("position"), F.array(F.lit(7), F.lit(8)).alias("tokens"))
    return B.interleave(steps, said, ["conv_id"]).select("conv_id", "step", F.size("tokens").cast("long").alias("size"), "offset")


@query("interleave", f"WITH {STREAM} SELECT * FROM so")
def interleave(T):
    return stream(T)


@query("tail_windows", f"""WITH {STREAM} SELECT a.conv_id, a.step, min(b.step) AS first_step FROM so a LEFT JOIN so b ON a.conv_id = b.conv_id AND b.step <= a.step AND b."offset" >= a."offset" + a.size - 5 GROUP BY 1, 2""")
def tail_windows(T):
    return B.tail_windows(stream(T), ["conv_id"], 5)


@query("tile_starts", "SELECT doc_id, len(range(0, n_chars - 511, 512)) AS tiles FROM documents")
def tile_starts(T):
    t = B.tiles(F.col("n_chars"), 512)
    return T("documents").select("doc_id", F.size(t).cast("long").alias("tiles"))


@query("site_days", f"""WITH {READ}, d AS (SELECT turbine, step // 86400 AS day, count(*) AS steps, sum(n)::BIGINT AS readings FROM g GROUP BY 1, 2),
k AS (SELECT turbine, t // 86400 AS day, count(*) AS faults FROM e WHERE cause = 'error' GROUP BY 1, 2) SELECT turbine, day, steps, readings, coalesce(faults, 0) AS faults FROM d LEFT JOIN k USING (turbine, day)""")
def site_days(T):
    day = F.expr("step div 86400").alias("day")
    d = readings(T).groupBy("turbine", day).agg(F.count("*").alias("steps"), F.sum("n").alias("readings"))
    k = raw(T).where("cause = 'error'").groupBy("turbine", day).agg(F.count("*").alias("faults"))
    return d.join(k, ["turbine", "day"], "left").withColumn("faults", F.coalesce("faults", F.lit(0)))


@query("fault_flags", "SELECT event_id, CASE WHEN event_type IN ('error') THEN true WHEN event_type IS NOT NULL THEN false END AS is_fault FROM events")
def fault_flags(T):
    return T("events").select("event_id", M.fault_flag(F.col("event_type"), F.lit(None).cast("string"), ["error"], [], None).alias("is_fault"))


@query("change_runs", f"WITH {READ} SELECT turbine, run::BIGINT AS run, count(*) AS n FROM (SELECT turbine, sum(CASE WHEN hi = ph THEN 0 ELSE 1 END) OVER (PARTITION BY turbine ORDER BY step) - 1 AS run FROM (SELECT turbine, step, power > 250 AS hi, lag(power > 250) OVER (PARTITION BY turbine ORDER BY step) AS ph FROM g)) GROUP BY 1, 2")
def change_runs(T):
    x = readings(T).withColumn("hi", F.col("power") > 250)
    return I.change_runs(x, ["turbine"], "step", ["hi"]).groupBy("turbine", "run").agg(F.count("*").alias("n"))
