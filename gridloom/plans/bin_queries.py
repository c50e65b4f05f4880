"""Bins and quantiles of the columns of lineitem, laid from order statistics without gathering a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import binning as B
from ..operators import quantiles as Q
from .registry import query

COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
SHARES = [k / 40 for k in range(41)]
LONG = " UNION ALL ".join(f"SELECT '{c}' AS channel, {c}::DOUBLE AS value FROM lineitem" for c in COLUMNS)
RULE = B.BinRule(16, masses=True, tail_bins=2)
PARTS = sorted({j / k for k in range(2, RULE.bins + 1) for j in range(1, k)})


def readings_by_column(T) -> DataFrame:
    """channel, value: four columns of lineitem as channels."""
    pairs = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("value")) for c in COLUMNS])
    return T("lineitem").select(F.inline(pairs))


@query("channel_quantiles", f"""WITH v AS ({LONG}), q AS (SELECT channel, quantile_cont(value, {SHARES}) AS q FROM v GROUP BY channel)
SELECT channel, unnest({SHARES}) AS share, round(unnest(q), 6) AS quantile FROM q""")
def channel_quantiles(T):
    """Forty-one exact quantiles of four columns, by refinement of ranges."""
    counted = Q.count_values(readings_by_column(T).withColumnRenamed("channel", "group"))
    shares = counted.select("group").distinct().select("group", F.explode(F.array(*[F.lit(s) for s in SHARES])).alias("share"))
    return Q.quantiles(counted, shares).select(F.col("group").alias("channel"), "share", F.round("quantile", 6).alias("quantile"))


@query("channel_bins", f"""WITH v AS ({LONG}), c AS (SELECT channel, value, count(*) AS n FROM v GROUP BY ALL),
t AS (SELECT channel, min(value) AS low, max(value) AS high, count(*) AS rows, quantile_cont(value, 0.005) AS ql, quantile_cont(value, 0.995) AS qh FROM v GROUP BY channel),
b AS (SELECT *, (value + lag(value) OVER w) / 2 AS b, (value + lead(value) OVER w) / 2 AS e FROM c WINDOW w AS (PARTITION BY channel ORDER BY value)),
h AS (SELECT b.channel, value, coalesce(b, '-infinity'::DOUBLE) AS b, coalesce(e, 'infinity'::DOUBLE) AS e FROM b JOIN t USING (channel) WHERE n * {RULE.bins} >= rows
      QUALIFY row_number() OVER (PARTITION BY b.channel ORDER BY n DESC, value DESC) <= {RULE.bins // 4}),
s AS (SELECT channel, low + (ql - low) * unnest([0.5, 1.0]) AS x FROM t WHERE ql <> low UNION ALL SELECT channel, high + (qh - high) * unnest([0.5, 1.0]) FROM t WHERE qh <> high),
f AS (SELECT channel, b AS x FROM h WHERE isfinite(b) UNION SELECT channel, e FROM h WHERE isfinite(e)
      UNION SELECT channel, x FROM s WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.channel = s.channel AND s.x BETWEEN h.b AND h.e)),
m AS (SELECT v.channel, v.value FROM v JOIN t USING (channel) WHERE v.value BETWEEN CASE WHEN ql <> low THEN ql ELSE low END AND CASE WHEN qh <> high THEN qh ELSE high END
      AND NOT EXISTS (SELECT 1 FROM h WHERE h.channel = v.channel AND h.value = v.value)),
q AS (SELECT channel, quantile_cont(value, {PARTS}) AS q FROM m GROUP BY channel), p AS (SELECT channel, unnest({PARTS}) AS share, unnest(q) AS x FROM q),
k AS (SELECT unnest(generate_series(2, {RULE.bins})) AS k), j AS (SELECT k, unnest(generate_series(1, k - 1)) / k::DOUBLE AS share FROM k),
u AS (SELECT DISTINCT k, channel, x FROM (SELECT k, channel, x FROM j JOIN p USING (share) WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.channel = p.channel AND p.x BETWEEN h.b AND h.e) UNION ALL SELECT k, channel, x FROM k, f UNION ALL SELECT 1, channel, x FROM f)
      JOIN t USING (channel) WHERE x > low AND x < high),
g AS (SELECT channel, max(k) AS k FROM (SELECT channel, k FROM u GROUP BY ALL HAVING count(*) < {RULE.bins}) GROUP BY channel),
a AS (SELECT channel, x FROM u JOIN g USING (channel, k) UNION SELECT channel, low FROM t UNION SELECT channel, high FROM t)
SELECT channel, row_number() OVER (PARTITION BY channel ORDER BY x) - 1 AS k, round(x, 6) AS edge FROM a""")
def channel_bins(T):
    """Bins with masses and tails of four columns; none of them is gathered in a task."""
    fitted = B.fit_bins(readings_by_column(T), RULE, held=0)
    return fitted.select("channel", F.posexplode("edges").alias("k", "x")).select("channel", F.col("k").cast("long").alias("k"), F.round("x", 6).alias("edge"))
