"""Queries of shards: numbered steps, running offsets, windows over chunks of tokens, mixed batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import shards as H
from .more_queries import token_streams
from .registry import HOUR, READ, query, raw, readings

NUMBERED = f"""{READ}, nu AS (SELECT *, turbine % 3 AS site, row_number() OVER (PARTITION BY turbine % 3 ORDER BY turbine, year, step) - 1 AS step_no FROM g)"""


def numbered(T):
    g = readings(T).withColumn("site", F.col("turbine") % 3)
    return H.number_steps(g, ["site"], ["turbine", "year"], "step")


@query("number_steps", f"WITH {NUMBERED} SELECT turbine, step, step_no FROM nu")
def number_steps(T):
    return numbered(T).select("turbine", "step", "step_no")


@query("window_index", f"""WITH {NUMBERED} SELECT site, turbine, year, step_no - 5 AS start_step, step_no AS end_step, step % 7200 = 0 AND coalesce(y, false) AND y IS NOT NULL AS y, step % 7200 = 0 AND y IS NOT NULL AS y_known
FROM (SELECT *, CASE WHEN n % 3 > 0 THEN power > 100 END AS y FROM nu) WHERE step % 7200 = 0""")
def window_index(T):
    x = numbered(T).withColumn("y", F.when(F.col("n") % 3 > 0, F.col("power") > 100)).withColumn("ok", F.col("step") % (2 * HOUR) == 0)
    return H.window_index(x, ["site"], ["turbine", "year"], ["y"], {"y": "ok"}, 6)


@query("running_offsets", """SELECT doc_id, source, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM documents""")
def running_offsets(T):
    return H.running_offsets(T("documents").select("doc_id", "source", "n_chars"), ["source"], "doc_id", F.col("n_chars"), leaf=7).select("doc_id", "source", "offset")


IDS = "list_transform(range(0, 1 + (n_chars % 23)::INT), lambda i: (doc_id * 31 + i) % 97)"


def documents_with_ids(T):
    ids = F.transform(F.sequence(F.lit(0), (F.col("n_chars") % 23).cast("int")), lambda i: (F.col("doc_id") * 31 + i) % 97)
    return T("documents").select("doc_id", "source", ids.alias("ids"))


@query("text_streams", f"SELECT source, sum(len({IDS}) + 1)::BIGINT AS tokens, greatest(0, sum(len({IDS}) + 1) - 19)::BIGINT AS windows FROM documents GROUP BY 1")
def text_streams(T):
    return H.text_streams(documents_with_ids(T), ["source"], "doc_id", "ids", 999, 20)[1]


@query("gather_windows", f"""WITH s AS (SELECT source, flatten(list(list_append({IDS}, 999) ORDER BY doc_id)) AS t FROM documents GROUP BY 1), w AS (SELECT source, unnest(range(0, len(t) - 29, 37)) AS first, t FROM s)
SELECT source, first, array_to_string(t[first + 1 : first + 30], ',') || ',0,0' AS tokens FROM w""")
def gather_windows(T):
    placed, totals = H.text_streams(documents_with_ids(T), ["source"], "doc_id", "ids", 999, 30)
    windows = totals.select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tokens") - 30, F.lit(37).cast("long"))).alias("first"), F.lit(30).alias("length"))
    out = H.gather(windows, H.chunked(placed, ["source"], "first_token", "ids", 64), ["source"], "first", "length", 64, 32)
    return out.select("source", "first", F.array_join(F.transform("tokens", lambda x: x.cast("string")), ",").alias("tokens"))


STEPS = """so AS (SELECT conv_id, turn AS step, 3 + length(text) % 9 AS size FROM conversations), sp AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY conv_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM so)"""


@query("tail_anchored", f"""WITH {STEPS}, w AS (SELECT a.conv_id, a.step, a."offset", a.size, a."offset" + a.size AS stop, (SELECT min(b.step) FROM sp b WHERE b.conv_id = a.conv_id AND b."offset" >= a."offset" + a.size - 10) AS fit, (SELECT min(b.step) FROM sp b WHERE b.conv_id = a.conv_id AND b.step > a.step - 3) AS early FROM sp a),
c AS (SELECT w.*, greatest(fit, early) AS s0, coalesce(greatest(fit, early) > step, true) OR fit IS NULL AS head_cut FROM w),
d AS (SELECT c.*, CASE WHEN head_cut THEN stop - 10 ELSE (SELECT b."offset" FROM sp b WHERE b.conv_id = c.conv_id AND b.step = s0) END AS first FROM c)
SELECT conv_id, step, first::BIGINT AS first, (stop - first)::BIGINT AS length, CASE WHEN head_cut THEN 0 ELSE step - s0 + 1 END AS steps_retained, head_cut, (stop - first - CASE WHEN head_cut THEN greatest(0, least(3, "offset" + 3 - first)) ELSE (step - s0 + 1) * 3 END)::BIGINT AS status_tokens FROM d""")
def tail_anchored(T):
    s = T("conversations").select("conv_id", F.col("turn").alias("step"), (3 + F.length("text") % 9).cast("long").alias("size"))
    s = H.running_offsets(s, ["conv_id"], "step", F.col("size"))
    return H.tail_anchored(s, ["conv_id"], 3, 10, 3).select("conv_id", "step", "first", "length", "steps_retained", "head_cut", "status_tokens")


@query("run_step_starts", f"""WITH {STEPS} SELECT conv_id, "offset" FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY "offset") - 1 AS n, sum(size) OVER (PARTITION BY conv_id) AS total FROM sp) WHERE n % 2 = 0 AND "offset" + 9 <= total""")
def run_step_starts(T):
    s = T("conversations").select("conv_id", F.col("turn").alias("step"), (3 + F.length("text") % 9).cast("long").alias("size"))
    totals = s.groupBy("conv_id").agg(F.sum("size").alias("total"), F.lit(0).alias("zero"))
    s = H.running_offsets(s, ["conv_id"], "step", F.col("size")).join(totals, "conv_id")
    return H.run_step_starts(s, ["conv_id"], "zero", "total", 2, 9).select("conv_id", "offset")


@query("stream_order", f"""WITH {NUMBERED} SELECT site, step_no, nth, message, start FROM (SELECT nu.site, nu.step_no, e.cause AS message, e.t AS start, row_number() OVER (PARTITION BY nu.site, nu.step_no ORDER BY e.t, e.cause) - 1 AS nth FROM e JOIN nu ON nu.turbine = e.turbine AND nu.step = e.step)""")
def stream_order(T):
    m = raw(T).select("turbine", "step", F.col("t").alias("start"), F.col("cause").alias("message"))
    return H.stream_order(m, numbered(T), ["turbine"], ["site"]).select("site", "step_no", "nth", "message", "start")


@query("step_message_counts", f"WITH {NUMBERED} SELECT turbine, step, (SELECT count(*) FROM e WHERE e.turbine = nu.turbine AND e.step = nu.step AND cause = 'view') AS messages FROM nu")
def step_message_counts(T):
    m = raw(T).where("cause = 'view'").select("turbine", "step")
    return H.step_message_counts(readings(T).select("turbine", "step"), m, ["turbine", "step"])


# the schedule drawn one by one: the stream with the largest deficit, the first of ties
DRAWN = """dr AS (SELECT 0 AS draw, 'a' AS stream, 1 AS a, 0 AS b, 0 AS c UNION ALL
SELECT draw + 1, p, a + (p = 'a')::INT, b + (p = 'b')::INT, c + (p = 'c')::INT FROM (SELECT *, CASE WHEN 5 * (draw + 2) - 10 * a >= greatest(3 * (draw + 2) - 10 * b, 2 * (draw + 2) - 10 * c) THEN 'a' WHEN 3 * (draw + 2) - 10 * b >= 2 * (draw + 2) - 10 * c THEN 'b' ELSE 'c' END AS p FROM dr) WHERE draw + 1 < (SELECT count(*) FROM benchmark) * 5)"""
SHARES = {"a": 0.5, "b": 0.3, "c": 0.2}


def drawn(T):
    return H.schedule(T("benchmark").sparkSession, SHARES, T("benchmark").count() * 5)


@query("mixture_schedule", f"WITH RECURSIVE {DRAWN} SELECT draw, stream FROM dr")
def mixture_schedule(T):
    """Five draws for each item of the benchmark, by the largest deficit."""
    return drawn(T).select("draw", "stream")


@query("mixture_plan", f"WITH RECURSIVE {DRAWN} SELECT stream, count(*) AS planned, (SELECT count(*) FROM documents WHERE doc_id % 3 = CASE stream WHEN 'a' THEN 0 WHEN 'b' THEN 1 ELSE 2 END) AS windows FROM dr GROUP BY 1")
def mixture_plan(T):
    pools = T("documents").groupBy(F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("doc_id") % 3 + 1).cast("int")).alias("stream")).agg(F.count("*").alias("windows"))
    return H.mixture_plan(drawn(T), pools)


@query("mixture_batches", f"""WITH RECURSIVE {DRAWN}, n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY draw) - 1 AS nth FROM dr), w AS (SELECT item_id, ['a', 'b', 'c'][(item_id % 3 + 1)::INT] AS stream FROM benchmark),
z AS (SELECT stream, count(*) AS size FROM w GROUP BY 1), p AS (SELECT n.*, nth // size AS pass, nth % size AS rank FROM n JOIN z USING (stream)),
o AS (SELECT w.stream, w.item_id, q.pass, row_number() OVER (PARTITION BY w.stream, q.pass ORDER BY md5('9:' || w.stream || ':' || q.pass || ':' || w.item_id)) - 1 AS rank FROM w JOIN (SELECT DISTINCT stream, pass FROM p) q ON q.stream = w.stream)
SELECT p.draw // 8 AS batch, p.draw, p.stream, o.item_id FROM p JOIN o USING (stream, pass, rank)""")
def mixture_batches(T):
    w = T("benchmark").select("item_id", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("item_id") % 3 + 1).cast("int")).alias("stream"))
    return H.mixture_batches(drawn(T), w, "item_id", 9, 8).select("batch", "draw", "stream", "item_id")


@query("balanced_cycle", """WITH s AS (SELECT id, id // 8 AS batch, id % 8 AS slot FROM (SELECT unnest(range(0, 400)) AS id)), n AS (SELECT batch, CASE WHEN slot < 3 THEN '1' ELSE '0' END AS stream, CASE WHEN slot < 3 THEN batch * 3 + slot ELSE batch * 5 + slot - 3 END AS nth FROM s),
w AS (SELECT doc_id, toxic::VARCHAR AS stream FROM labels), z AS (SELECT stream, count(*) AS size FROM w GROUP BY 1), p AS (SELECT n.*, nth // size AS pass, nth % size AS rank FROM n JOIN z USING (stream)),
o AS (SELECT w.stream, w.doc_id, q.pass, row_number() OVER (PARTITION BY w.stream, q.pass ORDER BY md5('4:' || w.stream || ':' || q.pass || ':' || w.doc_id)) - 1 AS rank FROM w JOIN (SELECT DISTINCT stream, pass FROM p) q ON q.stream = w.stream)
SELECT p.batch, o.doc_id, p.stream::INT AS toxic FROM p JOIN o USING (stream, pass, rank)""")
def balanced_cycle(T):
    return H.balanced_cycle(T("labels").select("doc_id", "toxic"), "doc_id", "toxic", 3, 8, 50, 4)


WIN = "wi AS (SELECT site, step_no - 5 AS start_step, step_no AS end_step, power > 100 AS label, turbine, year FROM nu WHERE step_no >= 5 AND step % 7200 = 0)"


def windows_of(T):
    x = numbered(T).where((F.col("step_no") >= 5) & (F.col("step") % (2 * HOUR) == 0))
    return x.select("site", (F.col("step_no") - 5).alias("start_step"), F.col("step_no").alias("end_step"), (F.col("power") > 100).alias("label"), "turbine", "year")


@query("missing_share", f"WITH {NUMBERED}, {WIN} SELECT wi.site, round(sum((nu.n = 1)::INT + (nu.power > 300)::INT) / (count(*) * 2), 9) AS share FROM wi JOIN nu ON nu.site = wi.site AND nu.step_no BETWEEN start_step AND end_step GROUP BY 1")
def missing_share(T):
    s = numbered(T).select("site", "step_no", ((F.col("n") == 1).cast("int") + (F.col("power") > 300).cast("int")).alias("m"))
    return H.missing_share(windows_of(T), s, ["site"], "start_step", "end_step", "m", 2).withColumn("share", F.round("share", 9))


@query("channel_absence", f"""WITH {NUMBERED}, {WIN}, j AS (SELECT nu.site, nu.step_no, nu.n = 1 AS a, nu.power > 300 AS b FROM wi JOIN nu ON nu.site = wi.site AND nu.step_no BETWEEN start_step AND end_step), u AS (SELECT DISTINCT * FROM j)
SELECT site, 'a' AS channel, round((SELECT avg(a::INT) FROM u WHERE u.site = j.site), 9) AS step_share, round(avg(a::INT), 9) AS window_share, bool_and(a) AS everywhere FROM j GROUP BY 1
UNION ALL SELECT site, 'b', round((SELECT avg(b::INT) FROM u WHERE u.site = j.site), 9), round(avg(b::INT), 9), bool_and(b) FROM j GROUP BY 1""")
def channel_absence(T):
    s = numbered(T).select("site", "step_no", F.when(F.col("n") != 1, 1).alias("a"), F.when(F.col("power") <= 300, 1).alias("b"))
    x = H.channel_absence(windows_of(T), s, ["site"], "start_step", "end_step", ["a", "b"])
    return x.withColumns({c: F.round(c, 9) for c in ("step_share", "window_share")})


@query("index_counts", f"WITH {NUMBERED}, {WIN} SELECT site, count(*) AS windows, count(*) FILTER (label) AS positives, count(DISTINCT end_step // 48) AS blocks, count(DISTINCT end_step // 48) FILTER (label) AS positive_blocks FROM wi GROUP BY 1")
def index_counts(T):
    return H.index_counts(windows_of(T), ["site"], "label", F.expr("end_step div 48"))


@query("turbine_years", f"""WITH {NUMBERED}, {WIN}, k AS (SELECT *, row_number() OVER (PARTITION BY turbine, year ORDER BY end_step) - 1 AS n FROM wi)
SELECT turbine, year, count(*) AS windows, count(*) FILTER (label) AS positives, round(avg(label::INT), 9) AS rate, (SELECT count(*) FROM e WHERE e.turbine = k.turbine AND e.year = k.year AND cause = 'error') AS events FROM k WHERE n % 4 = 0 GROUP BY 1, 2""")
def turbine_years(T):
    x = H.turbine_years(windows_of(T), raw(T).where("cause = 'error'"), 4)
    return x.withColumn("rate", F.round("rate", 9))


@query("choose_turbine", f"""WITH {NUMBERED}, {WIN}, k AS (SELECT *, row_number() OVER (PARTITION BY turbine, year ORDER BY end_step) - 1 AS n FROM wi), c AS (SELECT turbine, avg(label::INT) AS rate FROM k WHERE n % 4 = 0 GROUP BY 1, year),
o AS (SELECT *, abs(rate - 0.3) AS d FROM c ORDER BY d, turbine LIMIT 2) SELECT (SELECT turbine FROM o ORDER BY d, turbine LIMIT 1) AS turbine, (SELECT turbine FROM o ORDER BY d, turbine LIMIT 1 OFFSET 1) AS runner_up, (SELECT count(*) - 1 FROM c WHERE abs(rate - 0.3) = (SELECT min(d) FROM o)) AS ties""")
def choose_turbine(T):
    x = H.turbine_years(windows_of(T), raw(T).where("cause = 'error'"), 4)
    return H.choose(x, "rate", 0.3).select("turbine", "runner_up", "ties")


@query("last_real", """WITH st AS (SELECT conv_id, flatten(list(CASE WHEN role = 'assistant' THEN [7, 9, 8] ELSE [1, 40 + (length(text) % 5)::INT] END ORDER BY turn)) AS tokens FROM conversations GROUP BY 1)
SELECT conv_id, coalesce(list_max(list_transform(tokens, lambda x, i: CASE WHEN x <> 8 THEN i - 1 ELSE -1 END)), -1) AS last_real FROM st""")
def last_real(T):
    return token_streams(T).select("conv_id", H.last_real(F.col("tokens"), 8).alias("last_real"))
