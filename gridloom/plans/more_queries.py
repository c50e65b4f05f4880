"""Queries of token streams, samples, outages, manifests and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import metrics as K
from ..operators import samplers as P
from ..operators import temporal as J
from ..operators import tokens as N
from ..operators import vocab as V
from .metric_queries import DRAWS, SC, scored
from ..sources import sinks
from .registry import HOUR, READ, query, raw, readings, stops

STREAM = "st AS (SELECT conv_id, flatten(list(CASE WHEN role = 'assistant' THEN [7, 9, 8] ELSE [1, 40 + (length(text) % 5)::INT] END ORDER BY turn)) AS tokens FROM conversations GROUP BY 1)"


def token_streams(T):
    said = F.when(F.col("role") == "assistant", F.array(F.lit(7), F.lit(9), F.lit(8))).otherwise(F.array(F.lit(1), (40 + F.length("text") % 5).cast("int")))
    rows = T("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("t")))).alias("m"))
    return rows.select("conv_id", F.flatten(F.transform("m", lambda x: x["t"])).alias("tokens"))


@query("step_offsets", f"WITH {STREAM} SELECT conv_id, array_to_string(list_filter(list_transform(tokens, lambda x, i: CASE WHEN x = 1 THEN i - 1 END), lambda v: v IS NOT NULL), ',') AS offsets FROM st")
def step_offsets(T):
    p = F.transform(N.positions(F.col("tokens"), 1), lambda x: x.cast("string"))
    return token_streams(T).select("conv_id", F.array_join(p, ",").alias("offsets"))


@query("message_spans", f"WITH {STREAM} SELECT conv_id, len(list_filter(tokens, lambda x: x = 7)) AS spans, len(list_filter(tokens, lambda x: x NOT IN (7, 8, 9))) AS left_tokens FROM st")
def message_spans(T):
    x = token_streams(T).withColumn("s", N.message_spans(F.col("tokens"), 7, 8))
    return x.select("conv_id", F.size("s").cast("long").alias("spans"), F.size(N.drop_spans(F.col("tokens"), F.col("s"))).cast("long").alias("left_tokens"))


@query("token_frequency", f"WITH {STREAM} SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM st) GROUP BY 1")
def token_frequency(T):
    return N.token_counts(token_streams(T), "tokens")


@query("rare_tokens", f"WITH {STREAM}, c AS (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM st) GROUP BY 1) SELECT i::INT AS token, coalesce(n, 0) AS n FROM range(64) r(i) LEFT JOIN c ON token = i WHERE coalesce(n, 0) < 30")
def rare_tokens(T):
    return N.rare_tokens(N.token_counts(token_streams(T), "tokens"), 64, 30)


@query("bag_of_tokens", f"WITH {STREAM}, u AS (SELECT conv_id, len(list_filter(tokens, lambda x: x = 1)) AS steps, unnest(tokens) AS token FROM st) SELECT conv_id, token, round(count(*) / max(steps), 9) AS share FROM u WHERE token >= 9 GROUP BY 1, 2")
def bag(T):
    return N.bag_of_tokens(token_streams(T), ["conv_id"], "tokens", 9).withColumn("share", F.round("share", 9))


@query("mask_channels", f"WITH {STREAM} SELECT conv_id, list_sum(list_transform(tokens, lambda x, i: CASE WHEN (i - 1) % 5 = 2 THEN 2 ELSE x END))::BIGINT AS checksum FROM st")
def mask_channels(T):
    m = N.mask_channels(F.col("tokens"), [2], 5, 2)
    return token_streams(T).select("conv_id", F.aggregate(m, F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum"))


@query("flagged_spans", f"""WITH {READ} SELECT DISTINCT turbine, start, "end", EXISTS (SELECT 1 FROM s b WHERE b.turbine = a.turbine AND b.cause = 'error' AND b.start < a."end" AND a.start < b."end" AND b."end" > b.start) AS flagged FROM s a WHERE cause = 'view' AND "end" > start""")
def flagged_spans(T):
    x = stops(T)
    w = x.where("cause = 'view'").where(F.col("end") > F.col("start")).select("turbine", "start", "end").distinct()
    hit = J.overlap_join(w, x.where("cause = 'error'").drop("cause"), ["turbine"], 21600).select("turbine", "start", "end").distinct().withColumn("flagged", F.lit(True))
    return w.join(hit, ["turbine", "start", "end"], "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))


@query("flagged_steps", f"WITH {READ}, k AS (SELECT DISTINCT turbine, step FROM e WHERE cause = 'error') SELECT turbine, step, EXISTS (SELECT 1 FROM k WHERE k.turbine = g.turbine AND k.step BETWEEN g.step - 5 * 3600 AND g.step) AS flagged FROM g")
def flagged_steps(T):
    k = raw(T).where("cause = 'error'").select("turbine", F.col("step").alias("start")).distinct()
    return J.exists_behind(readings(T).select("turbine", "step"), k, ["turbine"], "step", "start", 5 * HOUR + 1, "flagged")


@query("seeded_sample", "SELECT doc_id FROM documents ORDER BY md5('11:' || doc_id), doc_id LIMIT 50")
def seeded_sample(T):
    """A sampling operator: fifty documents by seed."""
    return P.seeded_sample(T("documents").select("doc_id"), "doc_id", 50, 11)


@query("balanced_batches", """WITH n AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('3:' || doc_id), doc_id) - 1 AS k FROM labels WHERE quality IN (0, 1)),
b AS (SELECT doc_id, quality, k // CASE WHEN quality = 1 THEN 6 ELSE 2 END AS batch FROM n), m AS (SELECT min(c) AS batches FROM (SELECT count(*) // CASE WHEN quality = 1 THEN 6 ELSE 2 END AS c FROM n GROUP BY quality))
SELECT doc_id, quality, batch FROM b, m WHERE batch < batches""")
def balanced(T):
    return P.balanced_batches(T("labels").where("quality in (0, 1)").select("doc_id", "quality"), "doc_id", "quality", 6, 8, 3).select("doc_id", "quality", "batch")


@query("paired_deltas", f"""WITH {SC}, {DRAWS}, bl AS (SELECT doc_id % 20 AS block, label, score, round(1 - score, 2) AS other FROM sc),
c AS (SELECT 'a' AS k, replicate, score, sum(times) AS n, sum(times * label) AS pos FROM bl JOIN dr USING (block) GROUP BY 2, 3 UNION ALL SELECT 'b', replicate, other, sum(times), sum(times * label) FROM bl JOIN dr USING (block) GROUP BY 2, 3),
w AS (SELECT *, sum(n) OVER (PARTITION BY k, replicate ORDER BY score DESC) AS cn, sum(pos) OVER (PARTITION BY k, replicate ORDER BY score DESC) AS cp FROM c),
r AS (SELECT k, replicate, sum(pos * cp / cn) / sum(pos) AS ap FROM w GROUP BY 1, 2)
SELECT a.replicate, round(a.ap - b.ap, 9) AS delta FROM r a JOIN r b USING (replicate) WHERE a.k = 'a' AND b.k = 'b'""")
def paired(T):
    """The same block draws for two scorers, and the differences."""
    x = scored(T).withColumn("block", F.col("doc_id") % 20)
    a = K.bootstrap_ap(x, 50, 5).select("replicate", F.col("ap").alias("a"))
    b = K.bootstrap_ap(x.withColumn("score", F.round(1 - F.col("score"), 2)), 50, 5).select("replicate", F.col("ap").alias("b"))
    return a.join(b, "replicate").select("replicate", F.round(F.col("a") - F.col("b"), 9).alias("delta"))


@query("score_split", f"""WITH {SC}, c AS (SELECT source, score, count(*) AS n, sum(label) AS pos FROM sc GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY score DESC) AS cn, sum(pos) OVER (PARTITION BY source ORDER BY score DESC) AS cp FROM c),
a AS (SELECT source, sum(n)::BIGINT AS windows, round(CASE WHEN sum(pos) > 0 THEN sum(pos * cp / cn) / sum(pos) END, 9) AS ap FROM w GROUP BY 1),
l AS (SELECT source, round(avg(greatest(logit, 0) + ln(1 + exp(-abs(logit))) - label * logit), 9) AS loss FROM lg GROUP BY 1) SELECT source, windows, ap, loss FROM a JOIN l USING (source)""")
def score_split(T):
    x = scored(T)
    ap = K.average_precision(x, ["source"]).select("source", "windows", F.round("ap", 9).alias("ap"))
    return ap.join(K.cross_entropy(x, ["source"]).withColumn("loss", F.round("loss", 9)), "source")


@query("outage_shares", f"""WITH {READ} SELECT turbine, count(DISTINCT step) FILTER (step BETWEEN 1705276800 AND 1705449600) AS inside, count(DISTINCT step) FILTER (step BETWEEN 1705190400 AND 1705276799) AS before,
count(DISTINCT step) FILTER (step BETWEEN 1705449601 AND 1705536000) AS after FROM g GROUP BY 1""")
def outage(T):
    """Steps present inside a span and in the days either side, per turbine."""
    t, a, b = F.col("step"), 1705276800, 1705449600
    return readings(T).groupBy("turbine").agg(
        F.count_distinct(F.when(t.between(a, b), t)).alias("inside"), F.count_distinct(F.when(t.between(a - 86400, a - 1), t)).alias("before"),
        F.count_distinct(F.when(t.between(b + 1, b + 86400), t)).alias("after"),
    )


@query("out_of_range", f"WITH {READ}, b AS (SELECT turbine, min(power) AS lo, max(power) AS hi FROM g WHERE step <= 1705708800 GROUP BY 1) SELECT turbine, count(*) FILTER (power < lo) AS below, count(*) FILTER (power > hi) AS above FROM g JOIN b USING (turbine) GROUP BY 1")
def out_of_range(T):
    """Values beyond the training range of their turbine."""
    g = readings(T)
    b = g.where("step <= 1705708800").groupBy("turbine").agg(F.min("power").alias("lo"), F.max("power").alias("hi"))
    return g.join(b, "turbine").groupBy("turbine").agg(F.count_if(F.col("power") < F.col("lo")).alias("below"), F.count_if(F.col("power") > F.col("hi")).alias("above"))


@query("repeated_tail_values", """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.02) AS lo, quantile_cont(l_extendedprice, 0.98) AS hi FROM lineitem)
SELECT round(l_extendedprice, -3) AS value, count(*) AS n FROM lineitem, q WHERE l_extendedprice < lo OR l_extendedprice > hi GROUP BY 1 HAVING count(*) >= 10 ORDER BY n DESC, value LIMIT 4""")
def tails(T):
    """The four most repeated rounded values in the tails: a report."""
    x = T("lineitem").select("l_extendedprice")
    q = x.agg(F.percentile("l_extendedprice", F.lit(0.02)).alias("lo"), F.percentile("l_extendedprice", F.lit(0.98)).alias("hi"))
    far = x.join(F.broadcast(q)).where((F.col("l_extendedprice") < F.col("lo")) | (F.col("l_extendedprice") > F.col("hi")))
    counts = far.groupBy(F.round("l_extendedprice", -3).alias("value")).agg(F.count("*").alias("n")).where("n >= 10")
    return counts.orderBy(F.desc("n"), "value").limit(4)


@query("downtime_profile", "SELECT user_id AS turbine, count(*) AS n, count(*) FILTER ((epoch_us(ts) // 1000000) % 600 <> 0) AS off_grid, count(*) FILTER (value < 0) AS negative, count(*) FILTER (value >= 400) AS full_steps, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def downtime_profile(T):
    t = S.epoch_seconds(F.col("ts"))
    return T("events").groupBy(F.col("user_id").alias("turbine")).agg(
        F.count("*").alias("n"), F.count_if(t % 600 != 0).alias("off_grid"), F.count_if(F.col("value") < 0).alias("negative"),
        F.count_if(F.col("value") >= 400).alias("full_steps"), F.min("value").alias("low"), F.max("value").alias("high"),
    )


@query("manifest_upsert", """SELECT k, max(v) FILTER (src = 1) IS NOT NULL AS replaced, coalesce(max(v) FILTER (src = 1), max(v)) AS v FROM
(SELECT p_partkey AS k, p_size AS v, 0 AS src FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, p_size + 100, 1 FROM part WHERE p_partkey % 2 = 0) GROUP BY 1""")
def upsert(T):
    """Replace or append by key: the newer record wins."""
    p = T("part")
    old = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("k"), F.struct(F.lit(0).alias("src"), F.col("p_size").alias("v")).alias("r"))
    new = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k"), F.struct(F.lit(1).alias("src"), (F.col("p_size") + 100).alias("v")).alias("r"))
    return old.union(new).groupBy("k").agg(F.max("r").alias("r")).select("k", (F.col("r.src") == 1).alias("replaced"), F.col("r.v").alias("v"))


@query("download_plan", """SELECT p_partkey, CASE WHEN l IS NULL THEN 'fetch' ELSE 'again' END AS action FROM part LEFT JOIN (SELECT l_partkey AS l, bool_or(l_linestatus = 'F' AND l_quantity > 40) AS ok FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l = p_partkey WHERE ok IS NOT true""")
def download_plan(T):
    """What is wanted and not held verified: fetched anew where it was never held, again where it was held unverified."""
    ok = (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 40)
    held = T("lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.bool_or(ok).alias("verified"))
    return sinks.download_plan(T("part").select("p_partkey"), held, "p_partkey")


@query("vocabulary_coverage", """WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY 1),
b AS (SELECT word, count(*) AS c FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark) GROUP BY 1)
SELECT count(*) AS types, count(w.n) AS seen, count(*) FILTER (w.n >= 20) AS frequent, round(sum(CASE WHEN w.n IS NOT NULL THEN c ELSE 0 END) / sum(c), 9) AS token_coverage FROM b LEFT JOIN w USING (word)""")
def vocabulary_coverage(T):
    w = V.word_counts(T("documents"), []).select("word", "n")
    b = T("benchmark").select(F.explode(V.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("c"))
    j = b.join(w, "word", "left")
    seen = F.when(F.col("n").isNotNull(), F.col("c")).otherwise(0)
    return j.agg(F.count("*").alias("types"), F.count("n").alias("seen"), F.count_if(F.col("n") >= 20).alias("frequent"), F.round(F.sum(seen) / F.sum("c"), 9).alias("token_coverage"))


@query("forbidden_strings", """SELECT doc_id, line, count(*) AS hits FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line, unnest(l) AS said FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
LATERAL (SELECT unnest(regexp_extract_all(regexp_replace(lower(said), 'released under the mit license', '', 'g'), 'licensed?|secret')) AS h) x GROUP BY 1, 2""")
def forbidden(T):
    """Forbidden strings per line once allowed contexts are taken out."""
    lines = T("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "said"))
    left = F.regexp_replace(F.lower("said"), "released under the mit license", "")
    n = F.regexp_count(left, F.lit("licensed?|secret")).cast("long")
    return lines.select("doc_id", F.col("line").cast("long").alias("line"), n.alias("hits")).where("hits > 0")
