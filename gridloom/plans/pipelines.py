"""Whole pipelines as one declared plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import islands as I
from ..operators import splits as L
from ..operators import telemetry as M
from .registry import HOUR, READ, query, readings
from .series_queries import FAULTS, KEYS, TRAIN, VAL, faults


def telemetry(rows: DataFrame, starts: DataFrame, train_until: int, val_until: int, horizon: int = 24) -> DataFrame:
    """Clean, grid, segment, filter, impute, split and label rows (turbine, year, step, power)."""
    x = M.apply_bounds(M.drop_sentinels(rows, {"power": [100.0]}), {"power": (5.0, 480.0)})
    x = I.regular_grid(M.apply_floors(x, {"power": 10.0}), KEYS, "step", HOUR)
    x = M.drop_short_segments(I.segments(x, KEYS, "step", F.col("power").isNotNull(), 6 * HOUR), KEYS, 3)
    x = I.impute(x, KEYS, "step", "power", 3)
    x = x.withColumn("split", L.time_split(F.col("step"), train_until, val_until))
    x = L.cut_segments(x, KEYS)
    return M.label_steps(x, starts, [horizon], ["fault"], HOUR)


@query("telemetry_pipeline", f"""WITH {READ}, {FAULTS},
c AS (SELECT turbine, year, step, CASE WHEN v BETWEEN 5 AND 480 THEN CASE WHEN v < 10 THEN 10.0 ELSE v END END AS power FROM (SELECT *, CASE WHEN NOT abs(power - 100.0) <= 1e-4 THEN power END AS v FROM g)),
a AS (SELECT turbine, year, min(step) AS lo, max(step) AS hi FROM c GROUP BY 1, 2),
grid AS (SELECT a.turbine, a.year, x.step, c.power FROM a, LATERAL (SELECT unnest(generate_series(lo, hi, 3600)) AS step) x LEFT JOIN c ON c.turbine = a.turbine AND c.year = a.year AND c.step = x.step),
m AS (SELECT *, CASE WHEN power IS NOT NULL THEN sum(CASE WHEN power IS NOT NULL AND (pp IS NULL OR step - pp > 21600) THEN 1 ELSE 0 END) OVER (PARTITION BY turbine, year ORDER BY step) - 1 END AS id FROM
 (SELECT *, last_value(CASE WHEN power IS NOT NULL THEN step END IGNORE NULLS) OVER (PARTITION BY turbine, year ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pp FROM grid)),
k AS (SELECT *, last_value(id IGNORE NULLS) OVER (PARTITION BY turbine, year ORDER BY step) AS bk, first_value(id IGNORE NULLS) OVER (PARTITION BY turbine, year ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fw FROM m),
f1 AS (SELECT turbine, year, step, power, bk AS segment_id FROM k WHERE bk = fw QUALIFY count(*) OVER (PARTITION BY turbine, year, bk) >= 3),
b AS (SELECT *, row_number() OVER w AS p, count(power) OVER w AS blk FROM f1 WINDOW w AS (PARTITION BY turbine, year ORDER BY step)),
q AS (SELECT *, count(*) FILTER (power IS NULL) OVER (PARTITION BY turbine, year, blk) AS len FROM b),
z AS (SELECT *, last_value(CASE WHEN power IS NOT NULL THEN p END IGNORE NULLS) OVER v AS lp, last_value(power IGNORE NULLS) OVER v AS lv,
 first_value(CASE WHEN power IS NOT NULL THEN p END IGNORE NULLS) OVER n AS rp, first_value(power IGNORE NULLS) OVER n AS rv FROM q
 WINDOW v AS (PARTITION BY turbine, year ORDER BY step), n AS (PARTITION BY turbine, year ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
y AS (SELECT turbine, step, power IS NULL AND len <= 3 AND lp IS NOT NULL AND rp IS NOT NULL AS filled,
 CASE WHEN power IS NULL AND len <= 3 THEN lv + (rv - lv) * (p - lp) / (rp - lp) ELSE power END AS power, CASE WHEN step <= {TRAIN} THEN 'train' WHEN step <= {VAL} THEN 'val' ELSE 'test' END AS split FROM z),
u AS (SELECT turbine, step, 0 AS hit, 1 AS cov, split, power, filled FROM y UNION ALL SELECT turbine, start, 1, 0, NULL, NULL, NULL FROM f),
l AS (SELECT *, coalesce(sum(hit) OVER w, 0) AS h, coalesce(sum(cov) OVER w, 0) AS cc FROM u WINDOW w AS (PARTITION BY turbine ORDER BY step RANGE BETWEEN 1 FOLLOWING AND 86400 FOLLOWING))
SELECT split, count(*) AS n, count(*) FILTER (filled) AS imputed, round(sum(power), 3) AS total, count(*) FILTER (h > 0 OR cc >= 24) AS known, count(*) FILTER (h > 0) AS positive FROM l WHERE cov = 1 GROUP BY 1""")
def telemetry_pipeline(T):
    """From readings to labelled, imputed, split rows; tallied per split."""
    x = telemetry(readings(T).select(*KEYS, "step", "power"), faults(T), TRAIN, VAL)
    return x.groupBy("split").agg(
        F.count("*").alias("n"), F.count_if(F.col("power__imputed")).alias("imputed"), F.round(F.sum("power"), 3).alias("total"),
        F.count("fault").alias("known"), F.count_if(F.col("fault")).alias("positive"),
    )


@query("label_reconciliation", f"""WITH {READ}, {FAULTS}, stale AS (SELECT turbine, start FROM f WHERE start % 7 <> 3), u AS (SELECT turbine, step, 0 AS hit, 1 AS cov FROM g UNION ALL SELECT turbine, start, 1, 0 FROM stale),
l AS (SELECT *, coalesce(sum(hit) OVER w, 0) AS h, coalesce(sum(cov) OVER w, 0) AS c FROM u WINDOW w AS (PARTITION BY turbine ORDER BY step RANGE BETWEEN 1 FOLLOWING AND 21600 FOLLOWING)),
z AS (SELECT turbine, step, h > 0 AS pos, h = 0 AND c >= 6 AS neg, EXISTS (SELECT 1 FROM f WHERE f.turbine = l.turbine AND f.start > l.step AND f.start <= l.step + 21600) AS fresh FROM l WHERE cov = 1)
SELECT turbine, count(*) FILTER (pos) AS positive, count(*) FILTER (neg) AS negative, count(*) FILTER (NOT pos AND NOT neg) AS unknown, count(*) FILTER (pos <> fresh) AS mismatches FROM z GROUP BY 1""")
def reconciliation(T):
    """Labels made from a list of events that has lost some, by one range window, held against those of the whole list, by existence joins."""
    from ..operators import temporal as J

    g = readings(T).select("turbine", "step")
    y = J.horizon_labels(g, faults(T).where("start % 7 <> 3"), ["turbine"], 6, "y", HOUR)
    z = J.exists_ahead(y, faults(T), ["turbine"], "step", "start", 6 * HOUR, "hit")
    wrong = F.coalesce(F.col("y"), F.lit(False)) != F.col("hit")
    return z.groupBy("turbine").agg(
        F.count_if(F.col("y")).alias("positive"), F.count_if(~F.col("y")).alias("negative"), F.count_if(F.col("y").isNull()).alias("unknown"),
        F.count_if(wrong).alias("mismatches"),
    )


@query("seasonal_control", """WITH p AS (SELECT user_id % 2 AS arm, day(ts) BETWEEN 10 AND 20 AS season, event_type = 'error' AS bad FROM events)
SELECT arm, count(*) FILTER (season AND bad) AS events, count(*) FILTER (season) AS exposure, round(count(*) FILTER (season AND bad) / count(*) FILTER (season), 9) AS rate, round(count(*) FILTER (NOT season AND bad) / count(*) FILTER (NOT season), 9) AS other_rate FROM p GROUP BY 1""")
def seasonal(T):
    """Events over exposure inside a calendar window, against the rest."""
    season, bad = F.dayofmonth("ts").between(10, 20), F.col("event_type") == "error"
    x = T("events").groupBy((F.col("user_id") % 2).alias("arm")).agg(
        F.count_if(season & bad).alias("events"), F.count_if(season).alias("exposure"), F.count_if(~season & bad).alias("_b"), F.count_if(~season).alias("_n")
    )
    return x.select("arm", "events", "exposure", F.round(F.col("events") / F.col("exposure"), 9).alias("rate"), F.round(F.col("_b") / F.col("_n"), 9).alias("other_rate"))


@query("identity_hashes", "SELECT p_partkey, sha256('{\"brand\":\"' || p_brand || '\",\"size\":' || p_size || '}')[1:12] AS hash FROM part")
def identity_hashes(T):
    """Short hashes of canonical JSON with sorted keys."""
    payload = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")))
    return T("part").select("p_partkey", F.substring(F.sha2(payload.cast("binary"), 256), 1, 12).alias("hash"))
