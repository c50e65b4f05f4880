"""Queries of verdicts over intervals and of whole statistic sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as K
from ..operators import statistics as Z
from ..operators import verdicts as V
from .metric_queries import SC, scored
from .registry import query

IV = f"""{SC}, iv AS (SELECT lang, source, round(avg(score) - 0.42, 6) AS delta, round(avg(score) - 0.42 - 0.2 / sqrt(count(*)), 6) AS low, round(avg(score) - 0.42 + 0.2 / sqrt(count(*)), 6) AS high, (count(*) % 4) / 200.0 AS discarded, count(*) AS n FROM sc GROUP BY 1, 2),
tr AS (SELECT *, discarded <= 0.01 AS ok FROM iv)"""


def intervals(T):
    d, half = F.avg("score") - 0.42, 0.2 / F.sqrt(F.count("*"))
    return scored(T).groupBy("lang", "source").agg(
        F.round(d, 6).alias("delta"), F.round(d - half, 6).alias("low"), F.round(d + half, 6).alias("high"), ((F.count("*") % 4) / 200.0).alias("discarded"), F.count("*").alias("n")
    )


@query("paired_verdict", f"WITH {IV} SELECT lang, count(*) AS n, count(*) FILTER (ok AND low > -0.1) AS cleared, count(*) FILTER (NOT ok) AS untrusted, min(low) AS weakest, CASE WHEN count(*) <> 20 THEN 'not formed' WHEN count(*) FILTER (ok AND low > -0.1) = count(*) THEN 'met' ELSE 'not met' END AS verdict FROM tr GROUP BY 1")
def paired_verdict(T):
    return V.paired(intervals(T), ["lang"], -0.1, 20)


@query("sensitive_verdict", f"WITH {IV}, c AS (SELECT lang, max(high) AS control_high, bool_and(ok) AS c FROM tr WHERE source <> 'src0' GROUP BY 1) SELECT lang, low, control_high, CASE WHEN ok AND c AND low > control_high THEN 'sensitive' ELSE 'not sensitive' END AS verdict FROM tr JOIN c USING (lang) WHERE source = 'src0'")
def sensitive_verdict(T):
    x = intervals(T)
    return V.sensitive(x.where("source = 'src0'"), x.where("source <> 'src0'"), ["lang"])


@query("axis_verdict", f"WITH {IV} SELECT lang, count(*) AS seeds, count(*) FILTER (ok AND low > -0.12) AS clearing, CASE WHEN count(*) < 12 THEN 'not formed' WHEN count(*) FILTER (ok AND low > -0.12) >= 12 THEN 'evaluable' ELSE 'not evaluable' END AS verdict FROM tr GROUP BY 1")
def axis_verdict(T):
    return V.axis(intervals(T).withColumn("evaluable", V.evaluable(F.lit(-0.12))), ["lang"], 12)


@query("effect_verdict", f"WITH {IV}, e AS (SELECT lang, n % 2 AS half, quantile_cont(delta, 0.5) AS median, bool_and(ok AND low > -0.3) AS y, bool_and(ok AND high < 0.5) AS no FROM tr WHERE ok OR n % 2 = 0 GROUP BY 1, 2) SELECT lang, half, median, CASE WHEN y AND median > 0 AND no THEN 'both' WHEN y AND median > 0 THEN 'supported' WHEN no THEN 'refuted' ELSE 'inconclusive' END AS verdict FROM e")
def effect_verdict(T):
    x = intervals(T).withColumn("half", F.col("n") % 2).where((F.col("discarded") <= 0.01) | (F.col("half") == 0))
    return V.effect(x, ["lang", "half"], -0.3, 0.0, 0.5)


@query("ablation_verdict", f"WITH {IV}, e AS (SELECT source, quantile_cont(delta, 0.5) AS median, bool_and(ok AND high < 0) AS u, bool_and(ok AND low > 0) AS l, bool_and(ok AND low > -0.09 AND high < 0.09) AS b FROM tr GROUP BY 1), h AS (SELECT *, (u AND median < -0.09)::INT AS x, (l AND median > 0.09)::INT AS y, b::INT AS z FROM e) SELECT source, median, CASE WHEN x + y + z > 1 THEN 'as measured' WHEN x = 1 THEN 'hurts' WHEN y = 1 THEN 'helps' WHEN z = 1 THEN 'equivalent' ELSE 'inconclusive' END AS verdict FROM h")
def ablation_verdict(T):
    return V.ablation(intervals(T), ["source"], 0.09)


@query("gate_verdicts", f"WITH {IV} SELECT lang, source, CASE WHEN NOT ok THEN 'untrusted' WHEN high < 0.05 THEN 'pass' ELSE 'fail' END AS gate_a, CASE WHEN NOT ok THEN 'untrusted' WHEN high < 0.2 THEN 'damage' ELSE 'none' END AS gate_b FROM tr")
def gate_verdicts(T):
    return intervals(T).select("lang", "source", V.gate(0.05, "pass", "fail").alias("gate_a"), V.gate(0.2, "damage", "none").alias("gate_b"))


@query("abstention_verdict", f"WITH {IV} SELECT lang, source, CASE WHEN NOT ok OR high >= 0.15 THEN 'not evaluable' WHEN high >= 0.1 THEN 'not testable' WHEN high < 0.02 THEN 'supported' WHEN low >= -0.15 AND low > -0.14 THEN 'refuted' ELSE 'inconclusive' END AS verdict FROM tr")
def abstention_verdict(T):
    i = F.struct("low", "high", (F.col("discarded") <= 0.01).alias("trusted"))
    x = intervals(T).select("lang", "source", V.gate(0.15, "pass", "fail").alias("gate_a"), V.gate(0.1, "damage", "none").alias("gate_b"), i.alias("coverage"), i.alias("risk"))
    return V.abstention(x, 0.02, 0.02, -0.15, -0.14).select("lang", "source", "verdict")


@query("selection_verdict", f"WITH {IV} SELECT lang, count(*) FILTER (high < 0) AS worse, count(*) FILTER (NOT delta > -0.2) AS failing, CASE WHEN count(*) FILTER (high < 0 OR NOT delta > -0.2) > 0 THEN 'selected step' ELSE 'fixed final step' END AS verdict FROM tr GROUP BY 1")
def selection_verdict(T):
    x = intervals(T)
    return V.selection(x, x.withColumn("met", F.col("delta") > -0.2), ["lang"])


@query("masking_reading", f"WITH {IV}, p AS (SELECT lang, CASE WHEN low > 0 AND ok THEN 'clears' WHEN high < 0 THEN 'below' ELSE 'contains' END AS position FROM tr), c AS (SELECT lang, count(*) FILTER (position = 'clears') AS clears, count(*) FILTER (position = 'contains') AS contains, count(*) FILTER (position = 'below') AS below FROM p GROUP BY 1) SELECT *, CASE WHEN lang = 'en' AND clears >= 3 THEN 'first' WHEN contains >= 3 THEN 'second' ELSE 'neither' END AS clause FROM c")
def masking_reading(T):
    x = intervals(T).withColumn("position", K.interval_position(F.col("low"), F.col("high"), 0.0, F.col("discarded") <= 0.01))
    return V.masking(x, ["lang"], F.col("lang") == "en", 3)


@query("same_rows", "SELECT doc_id, 'first' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'second' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def same_rows(T):
    return V.same_rows(T("documents"), T("labels"), ["doc_id"])


ER = f"{SC}, er AS (SELECT *, round(1 - score, 2) / 3 AS u, abs(score - 0.5) AS margin, ((score >= 0.5)::INT <> label)::INT AS error FROM sc)"


def judged(T):
    return scored(T).withColumn("u", F.round(1 - F.col("score"), 2) / 3)


@query("random_aurc", f"""WITH {ER}, r AS (SELECT lang, seed, error, row_number() OVER (PARTITION BY lang, seed ORDER BY md5(seed || ':' || doc_id)) AS k FROM er, (SELECT unnest([11, 12, 13]) AS seed)),
c AS (SELECT lang, seed, avg(risk) AS a FROM (SELECT lang, seed, sum(error) OVER (PARTITION BY lang, seed ORDER BY k) / k AS risk FROM r) GROUP BY 1, 2) SELECT lang, round(avg(a), 9) AS aurc_random FROM c GROUP BY 1""")
def random_aurc(T):
    x = scored(T).withColumn("error", (F.col("score") >= 0.5).cast("int") != F.col("label"))
    return Z.random_aurc(x, ["lang"], "doc_id", [11, 12, 13]).withColumn("aurc_random", F.round("aurc_random", 9))


@query("statistics_set", f"""WITH {ER}, b AS (SELECT lang, avg(label) AS base_rate, avg(score) AS mean_p, avg((u <= 0.2)::INT) AS coverage, avg(error) FILTER (u <= 0.2) AS risk, avg((margin >= 0.15)::INT) AS margin_coverage, avg(error) FILTER (margin >= 0.15) AS margin_risk FROM er GROUP BY 1),
t AS (SELECT lang, sum(n * abs(mp - my)) / sum(n) AS ece FROM (SELECT lang, bin, count(*) AS n, avg(score) AS mp, avg(label) AS my FROM (SELECT *, ntile(5) OVER (PARTITION BY lang ORDER BY score, doc_id) AS bin FROM sc) GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT lang, score, count(*) AS n, sum(label) AS pos FROM sc GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY lang ORDER BY score DESC) AS cn, sum(pos) OVER (PARTITION BY lang ORDER BY score DESC) AS cp FROM c), a AS (SELECT lang, sum(pos * cp / cn) / sum(pos) AS auprc FROM w GROUP BY 1),
x AS (SELECT lang, avg(risk) AS aurc FROM (SELECT lang, sum(error) OVER v / row_number() OVER v AS risk FROM er WINDOW v AS (PARTITION BY lang ORDER BY u, doc_id ROWS UNBOUNDED PRECEDING)) GROUP BY 1),
y AS (SELECT lang, avg(risk) AS margin_aurc FROM (SELECT lang, sum(error) OVER v / row_number() OVER v AS risk FROM er WINDOW v AS (PARTITION BY lang ORDER BY margin DESC, doc_id ROWS UNBOUNDED PRECEDING)) GROUP BY 1)
SELECT lang, round(base_rate, 9) AS base_rate, round(mean_p, 9) AS mean_p, round(ece, 9) AS ece, round(auprc, 9) AS auprc, round(coverage, 9) AS coverage, round(risk, 9) AS risk, round(aurc, 9) AS aurc, round(margin_coverage, 9) AS margin_coverage, round(margin_risk, 9) AS margin_risk, round(margin_aurc, 9) AS margin_aurc FROM b JOIN t USING (lang) JOIN a USING (lang) JOIN x USING (lang) JOIN y USING (lang)""")
def statistics_set(T):
    x = Z.statistics(judged(T), ["lang"], "doc_id", 5, 0.5, 0.2, 0.15)
    return x.withColumns({c: F.round(c, 9) for c in x.columns if c != "lang"})


@query("ap_two_ways", f"WITH {SC}, c AS (SELECT lang, score, count(*) AS n, sum(label) AS pos FROM sc GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY lang ORDER BY score DESC) AS cn, sum(pos) OVER (PARTITION BY lang ORDER BY score DESC) AS cp FROM c) SELECT lang, round(sum(pos * cp / cn) / sum(pos), 9) AS ap FROM w GROUP BY 1")
def ap_two_ways(T):
    return Z.ap_by_thresholds(scored(T), ["lang"]).withColumn("ap", F.round("ap", 9))


@query("mean_predicted", f"WITH {SC} SELECT lang, round(avg(1 / (1 + exp(-(logit - 1.5)))), 9) AS mean_p FROM lg GROUP BY 1")
def mean_predicted(T):
    return Z.mean_predicted(scored(T), ["lang"], "logit", -1.5).withColumn("mean_p", F.round("mean_p", 9))
