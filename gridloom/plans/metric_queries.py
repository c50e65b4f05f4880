"""Queries of the evaluation statistics: labels joined to a deterministic score."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import metrics as K
from ..operators import replicates as R
from .registry import query

SC = """sc AS (SELECT l.doc_id, d.lang, d.source, l.quality AS label, round((d.n_chars % 997) / 997.0 * 0.8 + l.quality * 0.15, 2) AS score FROM labels l JOIN documents d USING (doc_id)),
lg AS (SELECT *, ln(greatest(0.01, least(0.99, score)) / (1 - greatest(0.01, least(0.99, score)))) AS logit FROM sc)"""


def scored(T):
    score = F.round((F.col("n_chars") % 997) / F.lit(997.0) * 0.8 + F.col("quality") * 0.15, 2)
    x = T("labels").join(T("documents"), "doc_id").select("doc_id", "lang", "source", F.col("quality").alias("label"), score.alias("score"))
    return x.withColumn("logit", S.logit(F.col("score"), 0.01)).withColumn("p", F.col("score"))


CUM = "c AS (SELECT lang, score, count(*) AS n, sum(label) AS pos FROM sc GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY lang ORDER BY score DESC) AS cn, sum(pos) OVER (PARTITION BY lang ORDER BY score DESC) AS cp FROM c)"


@query("average_precision", f"""WITH {SC}, {CUM} SELECT lang, sum(n)::BIGINT AS windows, sum(pos)::BIGINT AS positives,
round(CASE WHEN sum(pos) > 0 THEN sum(pos * cp / cn) / sum(pos) END, 9) AS ap, round(sum(pos) / sum(n), 9) AS base_rate,
round(CASE WHEN sum(pos) > 0 THEN sum(pos * cp / cn) / sum(pos) END / (sum(pos) / sum(n)), 9) AS lift FROM w GROUP BY 1""")
def average_precision(T):
    return K.average_precision(scored(T), ["lang"]).withColumns({c: F.round(c, 9) for c in ("ap", "base_rate", "lift")})


@query("cross_entropy", f"WITH {SC} SELECT lang, round(avg(greatest(logit, 0) + ln(1 + exp(-abs(logit))) - label * logit), 9) AS loss FROM lg GROUP BY 1")
def cross_entropy(T):
    return K.cross_entropy(scored(T), ["lang"]).withColumn("loss", F.round("loss", 9))


TABLE = "t AS (SELECT least(floor(score * 10), 9)::INT AS bin, count(*) AS n, avg(score) AS mean_p, avg(label) AS mean_y FROM sc GROUP BY 1)"


@query("calibration_table", f"WITH {SC}, {TABLE} SELECT bin, n, round(mean_p, 9) AS mean_p, round(mean_y, 9) AS mean_y FROM t")
def calibration(T):
    return K.calibration_table(scored(T), 10).withColumns({c: F.round(c, 9) for c in ("mean_p", "mean_y")})


@query("expected_calibration_error", f"WITH {SC}, {TABLE} SELECT round(sum(n * abs(mean_p - mean_y)) / sum(n), 9) AS ece FROM t")
def ece(T):
    return K.expected_calibration_error(K.calibration_table(scored(T), 10)).withColumn("ece", F.round("ece", 9))


@query("equal_mass_ece", f"""WITH {SC}, t AS (SELECT lang, bin, count(*) AS n, avg(score) AS mp, avg(label) AS my FROM (SELECT *, ntile(5) OVER (PARTITION BY lang ORDER BY score, doc_id) AS bin FROM sc) GROUP BY 1, 2)
SELECT lang, round(sum(n * abs(mp - my)) / sum(n), 9) AS ece FROM t GROUP BY 1""")
def equal_mass(T):
    return K.expected_calibration_error(K.equal_mass_table(scored(T), 5, ["lang"], "doc_id"), ["lang"]).withColumn("ece", F.round("ece", 9))


def judged(T):
    p = F.col("score")
    return scored(T).withColumn("confidence", F.greatest(p, 1 - p)).withColumn("error", (p >= 0.5).cast("int") != F.col("label"))


RC = f"{SC}, er AS (SELECT *, greatest(score, 1 - score) AS confidence, ((score >= 0.5)::INT <> label)::INT AS error FROM sc)"


@query("risk_coverage", f"WITH {RC} SELECT lang, doc_id, row_number() OVER w AS rank, round(sum(error) OVER (w ROWS UNBOUNDED PRECEDING) / row_number() OVER w, 9) AS risk FROM er WINDOW w AS (PARTITION BY lang ORDER BY confidence DESC, doc_id)")
def risk_coverage(T):
    return K.risk_coverage(judged(T), ["lang"], "doc_id").select("lang", "doc_id", "rank", F.round("risk", 9).alias("risk"))


@query("aurc", f"WITH {RC}, r AS (SELECT lang, error, sum(error) OVER (w ROWS UNBOUNDED PRECEDING) / row_number() OVER w AS risk FROM er WINDOW w AS (PARTITION BY lang ORDER BY confidence DESC, doc_id)) SELECT lang, round(avg(risk), 9) AS aurc, round(avg(error), 9) AS error_rate FROM r GROUP BY 1")
def aurc(T):
    return K.aurc(judged(T), ["lang"], "doc_id").withColumns({c: F.round(c, 9) for c in ("aurc", "error_rate")})


@query("coverage_and_risk", f"WITH {RC} SELECT lang, round(avg((confidence >= 0.7)::INT), 9) AS coverage, round(avg(error) FILTER (confidence >= 0.7), 9) AS risk FROM er GROUP BY 1")
def coverage_risk(T):
    return K.coverage_and_risk(judged(T), 0.7, ["lang"]).withColumns({c: F.round(c, 9) for c in ("coverage", "risk")})


@query("best_f1", f"WITH {SC}, {CUM}, f AS (SELECT *, round(2 * cp / (cn + sum(pos) OVER (PARTITION BY lang)), 12) AS f1 FROM w) SELECT lang, score AS tau, f1 FROM f QUALIFY row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, score) = 1")
def best_f1(T):
    return K.best_f1(scored(T), ["lang"])


@query("lower_quantile", f"WITH {SC} SELECT lang, list_sort(list(score))[1 + floor((count(*) - 1) * 0.9)::INT] AS cut FROM sc GROUP BY 1")
def lower_quantile(T):
    return K.lower_quantile(scored(T), "score", 0.9, ["lang"])


MEMBERS = f"{SC}, mb AS (SELECT doc_id, label, logit FROM lg UNION ALL SELECT doc_id, label, logit * 0.5 + 0.1 FROM lg)"


@query("ensemble", f"WITH {MEMBERS} SELECT doc_id, max(label) AS label, round(avg(1 / (1 + exp(-logit))), 9) AS p, round(stddev_pop(logit), 9) AS disagreement, count(*) AS members FROM mb GROUP BY 1")
def ensemble(T):
    a = scored(T).select("doc_id", "label", "logit")
    b = a.withColumn("logit", F.col("logit") * 0.5 + 0.1)
    return K.ensemble(a.union(b), "doc_id").withColumns({c: F.round(c, 9) for c in ("p", "disagreement")})


Z = "1.959963984540054"


@query("wilson_interval", f"""WITH {SC}, t AS (SELECT source, sum(label)::DOUBLE AS k, count(*)::DOUBLE AS n FROM sc GROUP BY 1)
SELECT source, round(greatest(0, (k/n + {Z}*{Z}/(2*n)) / (1 + {Z}*{Z}/n) - {Z}*sqrt(k/n*(1-k/n)/n + {Z}*{Z}/(4*n*n)) / (1 + {Z}*{Z}/n)), 9) AS low,
round(least(1, (k/n + {Z}*{Z}/(2*n)) / (1 + {Z}*{Z}/n) + {Z}*sqrt(k/n*(1-k/n)/n + {Z}*{Z}/(4*n*n)) / (1 + {Z}*{Z}/n)), 9) AS high FROM t""")
def wilson(T):
    t = scored(T).groupBy("source").agg(F.sum("label").alias("k"), F.count("*").alias("n"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return t.select("source", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("poisson_interval", f"""SELECT event_type, round(k * pow(1 - 1/(9*k) - {Z}/(3*sqrt(k)), 3), 6) AS low, round((k+1) * pow(1 - 1/(9*(k+1)) + {Z}/(3*sqrt(k+1)), 3), 6) AS high
FROM (SELECT event_type, count(*)::DOUBLE AS k FROM events GROUP BY 1)""")
def poisson(T):
    t = T("events").groupBy("event_type").agg(F.count("*").alias("k"))
    low, high = S.poisson_interval(F.col("k"))
    return t.select("event_type", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


STRATA = "st AS (SELECT user_id % 10 AS stratum, count(*) FILTER (event_type = 'error' AND day(ts) <= 15)::DOUBLE AS a, count(*) FILTER (day(ts) <= 15)::DOUBLE AS xa, count(*) FILTER (event_type = 'error' AND day(ts) > 15)::DOUBLE AS b, count(*) FILTER (day(ts) > 15)::DOUBLE AS xb FROM events GROUP BY 1)"


def strata(T):
    early, bad = F.dayofmonth("ts") <= 15, F.col("event_type") == "error"
    return T("events").groupBy((F.col("user_id") % 10).alias("stratum")).agg(
        F.count_if(bad & early).cast("double").alias("a"), F.count_if(early).cast("double").alias("at"),
        F.count_if(bad & ~early).cast("double").alias("b"), F.count_if(~early).cast("double").alias("bt"),
    )


@query("rate_ratio", f"WITH {STRATA} SELECT stratum, round((a/xa)/(b/xb), 9) AS ratio, round((a/xa)/(b/xb)*exp(-{Z}*sqrt(1/a+1/b)), 9) AS low, round((a/xa)/(b/xb)*exp({Z}*sqrt(1/a+1/b)), 9) AS high FROM st")
def rate_ratio(T):
    r, low, high = S.rate_ratio(F.col("a"), F.col("at"), F.col("b"), F.col("bt"))
    return strata(T).select("stratum", F.round(r, 9).alias("ratio"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("mantel_haenszel", f"WITH {STRATA} SELECT count(*) AS strata, round(sum(a * xb / (xa + xb)) / sum(b * xa / (xa + xb)), 9) AS ratio FROM st WHERE xa > 0 AND xb > 0")
def mantel(T):
    return K.mantel_haenszel(strata(T)).withColumn("ratio", F.round("ratio", 9))


DRAWS = """dr AS (SELECT replicate, ('0x' || substr(md5('5:' || replicate || ':' || draw), 1, 12))::BIGINT % 20 AS block, count(*) AS times
FROM (SELECT unnest(generate_series(0, 49)) AS replicate), (SELECT unnest(generate_series(0, 19)) AS draw) GROUP BY 1, 2)"""


@query("block_bootstrap", f"""WITH {SC}, {DRAWS}, bl AS (SELECT *, doc_id % 20 AS block FROM sc), c AS (SELECT replicate, score, sum(times) AS n, sum(times * label) AS pos FROM bl JOIN dr USING (block) GROUP BY 1, 2),
w AS (SELECT *, sum(n) OVER (PARTITION BY replicate ORDER BY score DESC) AS cn, sum(pos) OVER (PARTITION BY replicate ORDER BY score DESC) AS cp FROM c)
SELECT replicate, round(CASE WHEN sum(pos) > 0 THEN sum(pos * cp / cn) / sum(pos) END, 9) AS ap, round(sum(pos) / sum(n), 9) AS base_rate FROM w GROUP BY 1""")
def bootstrap(T):
    x = scored(T).withColumn("block", F.col("doc_id") % 20)
    return K.bootstrap_ap(x, 50, 5).withColumns({c: F.round(c, 9) for c in ("ap", "base_rate")})


@query("bootstrap_interval", f"""WITH {SC}, {DRAWS}, bl AS (SELECT *, doc_id % 20 AS block FROM sc), c AS (SELECT replicate, score, sum(times) AS n, sum(times * label) AS pos FROM bl JOIN dr USING (block) GROUP BY 1, 2),
w AS (SELECT *, sum(n) OVER (PARTITION BY replicate ORDER BY score DESC) AS cn, sum(pos) OVER (PARTITION BY replicate ORDER BY score DESC) AS cp FROM c),
r AS (SELECT replicate, CASE WHEN sum(pos) > 0 THEN sum(pos * cp / cn) / sum(pos) END AS ap FROM w GROUP BY 1)
SELECT round(quantile_cont(ap, 0.025), 9) AS low, round(quantile_cont(ap, 0.975), 9) AS high, round(avg(ap), 9) AS mean, count(*) - count(ap) AS discarded,
CASE WHEN quantile_cont(ap, 0.025) > 0.5 THEN 'clears' WHEN quantile_cont(ap, 0.975) < 0.5 THEN 'below' ELSE 'contains' END AS position FROM r""")
def bootstrap_interval(T):
    x = scored(T).withColumn("block", F.col("doc_id") % 20)
    i = K.percentile_interval(K.bootstrap_ap(x, 50, 5), "ap")
    i = i.withColumn("position", K.interval_position(F.col("low"), F.col("high"), 0.5, F.lit(True)))
    return i.withColumns({c: F.round(c, 9) for c in ("low", "high", "mean")})


@query("platt_fit")
def platt(T):
    x = scored(T)
    a, b = K.fit_platt(x)
    return x.select("doc_id", F.round(S.sigmoid(F.col("logit") * a + b), 6).alias("p"))


@query("balanced_shift")
def shift(T):
    x = scored(T)
    c = K.balanced_shift(x, "logit", 0.3)
    return x.agg(F.round(F.avg(S.sigmoid(F.col("logit") + c)), 3).alias("mean_p"), F.count("*").alias("n"))


@query("prior_correction", f"WITH {SC} SELECT doc_id, round(1 / (1 + exp(-(logit + ln(0.1 / 0.9)))), 9) AS p FROM lg")
def prior(T):
    return scored(T).select("doc_id", F.round(S.sigmoid(F.col("logit") + S.prior_correction(0.5, 0.1)), 9).alias("p"))


UNSURE = "us AS (SELECT doc_id % 20 AS block, score AS p, round(abs(score - 0.37), 2) AS u, label FROM sc)"


@query("replicate_statistics", f"""WITH {SC}, {DRAWS}, {UNSURE}, el AS (SELECT *, ((p >= 0.5)::INT <> label)::INT AS e, abs(p - 0.5) AS m FROM us),
ro AS (SELECT replicate, times, p, u, label, e, m FROM el JOIN dr USING (block)),
tt AS (SELECT replicate, sum(times) AS n, sum(times * label) AS pos, sum(times * p) AS sp, sum(times * e) AS err, sum(times) FILTER (u <= 0.2) AS c, sum(times * e) FILTER (u <= 0.2) AS ce, sum(times) FILTER (m >= 0.15) AS s, sum(times * e) FILTER (m >= 0.15) AS se FROM ro GROUP BY 1),
lo AS (SELECT replicate, 'p' AS kind, p AS v, times AS n, times * label AS k FROM ro UNION ALL SELECT replicate, 'u', u, times, times * e FROM ro UNION ALL SELECT replicate, 'm', -m, times, times * e FROM ro),
va AS (SELECT replicate, kind, v, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM lo GROUP BY ALL),
cu AS (SELECT *, (sum(n) OVER w)::BIGINT AS cn, (sum(k) OVER w)::BIGINT AS ck FROM va WINDOW w AS (PARTITION BY replicate, kind ORDER BY v)),
hn AS (SELECT 0::BIGINT AS i, 0::DOUBLE AS h UNION ALL SELECT i, sum(1.0::DOUBLE / i) OVER (ORDER BY i) FROM (SELECT unnest(generate_series(1, (SELECT max(n)::BIGINT + 1 FROM tt))) AS i)),
hs AS (SELECT i, h, coalesce(sum(h) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM hn),
ar AS (SELECT replicate, kind, sum(k::DOUBLE / cu.n * (cu.n * hh.h - (b.s - a.s)) / tt.n) AS area, sum(k * (pos - ck + k)::DOUBLE / (tt.n - cn + cu.n)) AS ap FROM cu JOIN tt USING (replicate) JOIN hs a ON a.i = cn - cu.n JOIN hs b ON b.i = cn JOIN hs hh ON hh.i = tt.n GROUP BY ALL),
bn AS (SELECT replicate, n, unnest([1, 2, 3, 4, 5]) AS j FROM tt), bb AS (SELECT replicate, j, (j - 1) * (n // 5) + least(j - 1, n % 5) AS lo, j * (n // 5) + least(j, n % 5) AS hi FROM bn),
ec AS (SELECT replicate, sum(gap) AS ece FROM (SELECT replicate, j, abs(sum((least(cn, hi) - greatest(cn - n, lo)) * (v - k::DOUBLE / n))) AS gap FROM cu JOIN bb USING (replicate) WHERE kind = 'p' AND least(cn, hi) > greatest(cn - n, lo) GROUP BY ALL) GROUP BY 1),
al AS (SELECT tt.*, ece, x.ap, y.area AS au, z.area AS am FROM tt LEFT JOIN ec USING (replicate) LEFT JOIN ar x ON x.replicate = tt.replicate AND x.kind = 'p' LEFT JOIN ar y ON y.replicate = tt.replicate AND y.kind = 'u' LEFT JOIN ar z ON z.replicate = tt.replicate AND z.kind = 'm'),
st AS (SELECT replicate, pos, unnest([{{'s': 'base_rate', 'v': pos / n}}, {{'s': 'mean_p', 'v': sp / n}}, {{'s': 'ece', 'v': ece / n}}, {{'s': 'auprc', 'v': ap / pos}}, {{'s': 'error_rate', 'v': err / n}}, {{'s': 'coverage', 'v': coalesce(c, 0) / n}}, {{'s': 'risk', 'v': ce / c}},
 {{'s': 'aurc', 'v': au}}, {{'s': 'margin_coverage', 'v': coalesce(s, 0) / n}}, {{'s': 'margin_risk', 'v': se / s}}, {{'s': 'margin_aurc', 'v': am}}]) AS x FROM al)
SELECT replicate, x.s AS statistic, CASE WHEN pos > 0 THEN round(x.v, 10) END AS value FROM st""")
def replicate_statistics(T):
    """Eleven statistics on each of fifty block bootstrap replicates."""
    x = scored(T).select((F.col("doc_id") % 20).alias("block"), F.col("score").alias("p"), F.round(F.abs(F.col("score") - 0.37), 2).alias("u"), "label")
    return R.replicate_statistics(x, 50, 5, 5, 0.5, 0.2, 0.15).withColumn("value", F.round("value", 10))
