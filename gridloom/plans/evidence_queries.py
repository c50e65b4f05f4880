"""Queries of cross-checks, site years, turbine-days, outages, clocks and text measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from .registry import HOUR, READ, query, raw, readings, stops
from .series_queries import FAULTS, faults

LOW, HIGH = 60.0, 300.0


@query("wind_states", f"""WITH {READ}, {FAULTS} SELECT state, count(*) AS n FROM (SELECT CASE WHEN g.power IS NULL THEN 'unknown' WHEN g.power < {LOW} THEN 'below_cut_in' WHEN g.power > {HIGH} THEN 'above_cut_out' ELSE 'inside' END AS state
FROM f LEFT JOIN g ON g.turbine = f.turbine AND g.step = f.start // 3600 * 3600) GROUP BY 1""")
def wind_states(T):
    return E.wind_states(faults(T), readings(T), "power", LOW, HIGH, HOUR).groupBy("state").agg(F.count("*").alias("n"))


@query("stopping_check", f"""WITH {READ}, d AS (SELECT turbine, step FROM g WHERE power >= 150), a AS (SELECT row_number() OVER () AS id, * FROM s WHERE cause IN ('view', 'click')),
x AS (SELECT a.id, cause, count(d.step) > 0 AS shows FROM a LEFT JOIN d ON d.turbine = a.turbine AND d.step BETWEEN a.start // 3600 * 3600 AND a."end" // 3600 * 3600 + 7200 GROUP BY 1, 2)
SELECT cause AS code, cause = 'view' AS stopping, count(*) AS occurrences, count(*) FILTER (shows) AS showing, count(*) FILTER (shows = (cause = 'view')) AS agreeing, round(avg((shows = (cause = 'view'))::INT), 9) AS agreement FROM x GROUP BY 1, 2""")
def stopping_check(T):
    x = E.stopping_check(stops(T).withColumnRenamed("cause", "code"), readings(T).where("power >= 150"), {"view": True, "click": False}, 2, HOUR)
    return x.withColumn("agreement", F.round("agreement", 9))


STATE = f"""{READ}, q AS (SELECT turbine, step, coalesce(sum(value) FILTER (cause = 'click'), 0) AS a, coalesce(sum(value) FILTER (cause = 'view'), 0) AS b, avg(value) AS v FROM e GROUP BY 1, 2),
l AS (SELECT turbine, step, v, 'a' AS timer, round(a, 6) AS s FROM q WHERE round(a, 6) > 0 UNION ALL SELECT turbine, step, v, 'b', round(b, 6) FROM q WHERE round(b, 6) > 0),
m AS (SELECT *, count(*) OVER (PARTITION BY timer, step) AS at_once, sum(CASE WHEN step - p <= 3600 THEN 0 ELSE 1 END) OVER (PARTITION BY timer, turbine ORDER BY step) AS run FROM (SELECT *, lag(step) OVER (PARTITION BY timer, turbine ORDER BY step) AS p FROM l)),
r AS (SELECT timer, quantile_cont(s, 0.5) AS med, quantile_cont(s, 0.9) AS p90 FROM (SELECT timer, turbine, run, sum(s) AS s FROM m GROUP BY 1, 2, 3) GROUP BY 1)"""


@query("timer_profiles", f"""WITH {STATE} SELECT m.timer, 'c' || m.timer AS cause, count(*) AS steps, round(sum(s), 3) AS seconds, round(avg((v <= 50)::INT), 9) AS telemetry_missing, round(avg((v > 100)::INT), 9) AS rotating, round(avg((v > 200)::INT), 9) AS producing,
quantile_cont(at_once, 0.5) AS turbines_at_once, round(avg((at_once >= 3)::INT), 9) AS farm_wide, round(any_value(med), 3) AS median_run_s, round(any_value(p90), 3) AS p90_run_s FROM m JOIN r USING (timer) GROUP BY m.timer""")
def timer_profiles(T):
    part = lambda c: F.round(F.coalesce(F.sum(F.when(F.col("cause") == c, F.col("value"))), F.lit(0)), 6)
    state = raw(T).groupBy("turbine", "step").agg(part("click").alias("a"), part("view").alias("b"), F.avg("value").alias("v"))
    state = state.select("turbine", "step", "a", "b", (F.col("v") > 50).alias("telemetry_present"), F.col("v").alias("rotor_speed_rpm"), F.col("v").alias("power_pu"))
    x = E.timer_profiles(state, {"a": "ca", "b": "cb"}, 6, 100, 200, HOUR)
    return x.withColumns({c: F.round(c, 3) for c in ("seconds", "median_run_s", "p90_run_s")} | {c: F.round(c, 9) for c in ("telemetry_missing", "rotating", "producing", "farm_wide")})


TENTHS = f"""{READ}, {FAULTS}, st AS (SELECT *, step // 864000 AS tenth FROM g), na AS (SELECT *, t // 864000 AS tenth, cause AS opening FROM e WHERE cause IN ('error', 'view') AND value > 30), br AS (SELECT *, t // 864000 AS tenth FROM e WHERE cause <> 'click'),
ro AS (SELECT tenth, (SELECT count(*) FROM st WHERE st.tenth = x.tenth) AS steps, (SELECT count(*) FROM na WHERE na.tenth = x.tenth) AS narrow, (SELECT count(*) FROM br WHERE br.tenth = x.tenth) AS broad,
 CASE WHEN tenth <= 1972 THEN 'train' WHEN tenth = 1973 THEN 'val' ELSE 'test' END AS split FROM (SELECT DISTINCT tenth FROM st) x),
pe AS (SELECT tenth, turbine, count(*) AS n FROM na GROUP BY 1, 2), bu AS (SELECT tenth, turbine AS busiest, n AS busiest_narrow FROM pe QUALIFY row_number() OVER (PARTITION BY tenth ORDER BY n DESC, turbine) = 1),
op AS (SELECT tenth, opening, count(*) AS n, any_value(split) AS split FROM na JOIN ro USING (tenth) GROUP BY 1, 2),
ld AS (SELECT opening FROM op GROUP BY 1 ORDER BY sum(CASE WHEN split = 'test' THEN n ELSE 0 END) / (SELECT sum(steps) FROM ro WHERE split = 'test') - sum(CASE WHEN split = 'train' THEN n ELSE 0 END) / (SELECT sum(steps) FROM ro WHERE split = 'train') DESC, opening DESC LIMIT 1),
ye AS (SELECT ro.*, busiest, coalesce(busiest_narrow, 0) AS busiest_narrow, (SELECT opening FROM ld) AS leading_message, coalesce((SELECT n FROM op WHERE op.tenth = ro.tenth AND op.opening = (SELECT opening FROM ld)), 0) AS leading FROM ro LEFT JOIN bu USING (tenth))"""


def years(T):
    tenth = lambda c: F.expr(f"{c} div 864000")
    e = raw(T).withColumn("tenth", tenth("t"))
    split = {k: "train" if k <= 1972 else "val" if k == 1973 else "test" for k in range(1960, 1985)}
    narrow = e.where("cause in ('error', 'view') and value > 30").withColumn("opening", F.col("cause"))
    return E.site_years(readings(T).withColumn("tenth", tenth("step")), narrow, e.where("cause <> 'click'"), "tenth", split, 1)


@query("site_years", f"WITH {TENTHS} SELECT * FROM ye")
def site_years(T):
    return years(T)


@query("pooled_years", f"WITH {TENTHS} SELECT split, sum(narrow)::BIGINT AS narrow, sum(steps)::BIGINT AS steps FROM ye GROUP BY 1")
def pooled_years(T):
    return E.pooled(years(T))


@query("onset_year", f"""WITH {TENTHS}, tr AS (SELECT sum(narrow) / (sum(steps) / 1000.0) AS rate FROM ye WHERE split = 'train')
SELECT min(CASE WHEN split IN ('val', 'test') AND narrow * pow(1 - 1 / (9.0 * narrow) - 1.959963984540054 / (3 * sqrt(narrow)), 3) / (steps / 1000.0) > rate THEN tenth END) AS onset, min(CASE WHEN ye."leading" / (steps / 1000.0) > 1 THEN tenth END) AS routine FROM ye, tr""")
def onset_year(T):
    return E.onset_year(years(T), "tenth", 1000.0)


DAYS = f"""{READ}, {FAULTS}, q AS (SELECT turbine, step, avg(value) FILTER (cause = 'click') AS a, avg(value) FILTER (cause = 'view') AS b, avg(value) FILTER (cause <> 'signup') AS r FROM e GROUP BY 1, 2),
dy AS (SELECT turbine, step // 86400 AS day, count(*) AS steps, count(*) FILTER (step % 7 <> 3) AS kept, count(r) AS reporting, count(r) FILTER (step % 7 <> 3) AS reporting_kept,
 count(a) AS nonnull_a, count(a) FILTER (step % 7 <> 3) AS nonnull_kept_a, count(*) FILTER (r IS NOT NULL AND a IS NULL) AS missing_a, count(*) FILTER (r IS NOT NULL AND a IS NULL AND step % 7 <> 3) AS missing_kept_a,
 count(b) AS nonnull_b, count(b) FILTER (step % 7 <> 3) AS nonnull_kept_b, count(*) FILTER (r IS NOT NULL AND b IS NULL) AS missing_b, count(*) FILTER (r IS NOT NULL AND b IS NULL AND step % 7 <> 3) AS missing_kept_b FROM q GROUP BY 1, 2),
de AS (SELECT dy.*, coalesce(n, 0) AS events FROM dy LEFT JOIN (SELECT turbine, start // 86400 AS day, count(*) AS n FROM f GROUP BY 1, 2) USING (turbine, day))"""


def channels_of(T):
    part = lambda c: F.avg(F.when(c, F.col("value")))
    cause = F.col("cause")
    return raw(T).groupBy("turbine", "step").agg(part(cause == "click").alias("a"), part(cause == "view").alias("b"), part(cause != "signup").alias("r"))


def days_of(T):
    return E.turbine_days(channels_of(T), ["a", "b"], "r", faults(T), F.col("step") % 7 != 3)


@query("turbine_days", f"WITH {DAYS} SELECT * FROM de")
def turbine_days(T):
    return days_of(T)


@query("channel_shares", f"WITH {DAYS} SELECT turbine % 10 AS site, round(sum(nonnull_kept_a) / sum(kept), 9) AS a, round(sum(nonnull_kept_b) / sum(kept), 9) AS b FROM de GROUP BY 1 HAVING sum(kept) >= 144")
def channel_shares(T):
    x = E.channel_shares(days_of(T).withColumn("site", F.col("turbine") % 10), ["a", "b"], ["site"], True, 144)
    return x.withColumns({c: F.round(c, 9) for c in ("a", "b")})


MATCH = """x AS (SELECT *, reporting > 0 AND missing_a > 0.9 * reporting AS hit, month(DATE '1970-01-01' + day::INT) AS mo FROM de),
st AS (SELECT mo, sum(events) FILTER (hit)::DOUBLE AS a, sum(steps) FILTER (hit) / 52560.0 AS xa, sum(events) FILTER (NOT hit)::DOUBLE AS b, sum(steps) FILTER (NOT hit) / 52560.0 AS xb, count(*) FILTER (hit) AS d FROM x GROUP BY 1),
su AS (SELECT sum(d)::BIGINT AS affected_days, sum(a) AS a, sum(xa) AS xa, sum(b) AS b, sum(xb) AS xb, count(*) FILTER (xa > 0 AND xb > 0) AS months, sum(a * xb / (xa + xb)) AS r, sum(b * xa / (xa + xb)) AS s, sum((a + b) * xa * xb / ((xa + xb) * (xa + xb))) AS v FROM st),
z AS (SELECT *, (a / xa) / (b / xb) AS crude, 1.959963984540054 * sqrt(1 / a + 1 / b) AS h, r / s AS m, 1.959963984540054 * sqrt(v / (r * s)) AS w FROM su)"""


@query("matched_ratio", f"""WITH {DAYS}, {MATCH} SELECT affected_days, round(crude, 9) AS crude, round(crude * exp(-h), 9) AS crude_low, round(crude * exp(h), 9) AS crude_high, round(m, 9) AS matched, round(m * exp(-w), 9) AS matched_low, round(m * exp(w), 9) AS matched_high, months,
CASE WHEN m IS NULL THEN 'no events' WHEN m * exp(-w) > 1 OR m * exp(w) < 1 THEN 'does not clear' WHEN m * exp(-w) >= 0.8 AND m * exp(w) <= 1.25 THEN 'clears' ELSE 'inconclusive' END AS reading FROM z""")
def matched_ratio(T):
    x = E.matched_ratio(days_of(T), "a", 0.9)
    return x.withColumns({c: F.round(c, 9) for c in ("crude", "crude_low", "crude_high", "matched", "matched_low", "matched_high")})


SPAN = (1705300000, 1705900000)


@query("outage_tally", f"""WITH {DAYS} SELECT turbine, count(*) FILTER (i) AS inside, count(r) FILTER (i) AS reporting, count(r) FILTER (i AND a IS NULL AND b IS NULL) AS out, count(r) FILTER (p) AS before_reporting, count(r) FILTER (p AND a IS NOT NULL AND b IS NOT NULL) AS before_present,
count(r) FILTER (n) AS after_reporting, count(r) FILTER (n AND a IS NOT NULL AND b IS NOT NULL) AS after_present
FROM (SELECT *, step BETWEEN {SPAN[0]} AND {SPAN[1]} AS i, step >= {SPAN[0] - 604800} AND step < {SPAN[0]} AS p, step > {SPAN[1]} AND step <= {SPAN[1] + 604800} AS n FROM q) GROUP BY 1""")
def outage_tally(T):
    return E.outage_tally(channels_of(T), "r", ["a", "b"], *SPAN)


@query("outage_holds", f"""WITH {DAYS}, t AS (SELECT turbine, count(r) FILTER (i) AS n, count(r) FILTER (i AND a IS NULL AND b IS NULL) AS o, count(r) FILTER (p) AS pr, count(r) FILTER (p AND a IS NOT NULL AND b IS NOT NULL) AS pp, count(r) FILTER (f) AS fr, count(r) FILTER (f AND a IS NOT NULL AND b IS NOT NULL) AS fp
FROM (SELECT *, step BETWEEN {SPAN[0]} AND {SPAN[1]} AS i, step >= {SPAN[0] - 604800} AND step < {SPAN[0]} AS p, step > {SPAN[1]} AND step <= {SPAN[1] + 604800} AS f FROM q) GROUP BY 1)
SELECT true AS several, count(*) FILTER (n > 0) = count(*) AS site_wide, coalesce(min(o / n) FILTER (n > 0) >= 0.99, false) AS simultaneous, coalesce(sum(pp) / sum(pr) > 0.005, false) AND coalesce(sum(fp) / sum(fr) > 0.005, false) AS bounded FROM t""")
def outage_holds(T):
    return E.outage_holds(E.outage_tally(channels_of(T), "r", ["a", "b"], *SPAN), 2, edge_share=0.005)


@query("gap_rows", f"""WITH {DAYS}, y AS (SELECT q.*, CASE WHEN (SELECT count(*) FROM f WHERE f.turbine = q.turbine AND f.start > q.step AND f.start <= q.step + 86400) > 0 THEN true WHEN step % 3 > 0 THEN false END AS lab FROM q)
SELECT turbine, count(*) AS steps, count(r) AS reporting, round(coalesce(count(*) FILTER (r IS NOT NULL AND a IS NULL) / nullif(count(r), 0), 0), 9) AS missing_a, count(*) FILTER (lab IS NOT NULL AND r IS NOT NULL AND a IS NULL) AS known_missing, count(*) FILTER (lab AND r IS NOT NULL AND a IS NULL) AS positive_missing,
count(*) FILTER (lab IS NOT NULL AND r IS NOT NULL AND a IS NOT NULL) AS known_present, count(*) FILTER (lab AND r IS NOT NULL AND a IS NOT NULL) AS positive_present FROM y GROUP BY 1""")
def gap_rows(T):
    from ..operators import temporal as J

    x = J.exists_ahead(channels_of(T), faults(T), ["turbine"], "step", "start", 86400, "hit")
    x = x.withColumn("lab", F.when(F.col("hit"), True).when(F.col("step") % 3 > 0, False))
    return E.gap_rows(x, "r", ["a"], "lab", ["turbine"]).withColumn("missing_a", F.round("missing_a", 9))


@query("power_scale", """SELECT round(quantile_cont(t, 0.5), 6) AS tail, CASE WHEN quantile_cont(t, 0.5) BETWEEN 300 / 1.5 AND 300 * 1.5 THEN 'kW' ELSE 'unresolved' END AS verdict FROM (SELECT user_id, quantile_cont(value, 0.99) AS t FROM events GROUP BY 1)""")
def power_scale(T):
    x = E.power_scale(T("events"), ["user_id"], "value", 300.0, 1 / 6)
    return x.withColumn("tail", F.round("tail", 6))


@query("dataset_intervals", """WITH c AS (SELECT o_orderpriority AS farm, o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1, 2), t AS (SELECT label, 'all' AS farms, sum(n)::DOUBLE AS n FROM c GROUP BY 1 UNION ALL SELECT label, 'without', sum(n) FROM c WHERE farm <> '1-URGENT' GROUP BY 1),
k AS (SELECT *, round(n / 2) / n AS p, 1.959963984540054 AS z FROM t) SELECT label, farms, n::BIGINT AS datasets, round(greatest(0, (p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 9) AS low, round(least(1, (p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 9) AS high FROM k""")
def dataset_intervals(T):
    c = T("orders").groupBy(F.col("o_orderpriority").alias("farm"), F.col("o_orderstatus").alias("label")).agg(F.count("*").alias("n"))
    return E.dataset_intervals(c, "1-URGENT").withColumns({x: F.round(x, 9) for x in ("low", "high")})


@query("header_presence", """SELECT 'click' AS channel, day(ts) AS year, count(DISTINCT user_id) AS files, count(DISTINCT CASE WHEN event_type = 'click' THEN user_id END) AS "with" FROM events GROUP BY 2
UNION ALL SELECT 'view', day(ts), count(DISTINCT user_id), count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) FROM events GROUP BY 2""")
def header_presence(T):
    headers = T("events").groupBy("user_id", F.dayofmonth("ts").cast("long").alias("year")).agg(F.collect_set("event_type").alias("columns"))
    return E.header_presence(headers, {"click": "click", "view": "view"})


@query("derive_core", "SELECT p_type AS channel, count(DISTINCT p_brand) = 3 AS core FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') GROUP BY 1")
def derive_core(T):
    maps = T("part").select(F.col("p_brand").alias("source"), F.col("p_type").alias("channel"))
    return E.derive_core(maps, ["Brand#11", "Brand#12"], ["Brand#13"])


@query("text_measures", """WITH c AS (SELECT role, trim(text) AS t, count(*) AS n FROM conversations WHERE trim(text) <> '' GROUP BY 1, 2), m AS (SELECT role, sum(n)::BIGINT AS rows, count(*) AS "distinct", sum(length(t) * n) / sum(n) AS mean_chars, sum(len(regexp_extract_all(t, '[^ \\t\\n\\v\\f\\r]+')) * n) / sum(n) AS mean_words, avg((n = 1)::INT) AS once_share FROM c GROUP BY 1)
SELECT role, rows, "distinct", round(mean_chars, 9) AS mean_chars, round(mean_words, 9) AS mean_words, round(once_share, 9) AS once_share, CASE WHEN once_share >= 0.5 AND mean_words >= 4 THEN 'written' ELSE 'coded' END AS verdict FROM m""")
def text_measures(T):
    x = E.free_text_verdict(E.text_measures(T("conversations"), ["role"], "text"))
    return x.withColumns({c: F.round(c, 9) for c in ("mean_chars", "mean_words", "once_share")})


@query("channel_verdicts", """WITH s AS (SELECT l_shipmode AS channel, share FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, avg((l_discount > 0.01)::INT) AS share FROM lineitem GROUP BY 1))
SELECT channel, true AS maps, share >= 0.8 AS a, share >= 0.8 AS b, share >= 0.8 OR share = 0 AS c, CASE WHEN share >= 0.8 THEN 'all hold' ELSE '(a)' END AS reason, CASE WHEN share >= 0.8 THEN 'core' ELSE 'extended' END AS tier FROM s""")
def channel_verdicts(T):
    x = T("lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("channel")).agg(F.avg((F.col("l_discount") > 0.01).cast("double")).alias("share"))
    roles = F.explode(F.array(F.lit("held_out"), F.lit("training")))
    x = x.select("channel", "share", F.col("share").alias("kept_share"), F.lit("inconclusive").alias("reading"), F.lit(True).alias("mappable"), roles.alias("role"))
    return E.channel_verdicts(x, 0.8)


