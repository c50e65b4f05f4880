"""Queries of a mixture of readings, messages and text, written as shards and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mixture as M
from ..operators.tables import new_folder
from .registry import HOUR, READ, query, raw, readings

CONTEXT, STRIDE, OFFSET, SEPARATOR, JOINT, UNTIL = 24, 3, 1184, 99, 5, 1705708800
STEPS = f"""{READ}, st AS (SELECT 's' || turbine % 3 AS source, CASE WHEN step < {UNTIL} THEN 'train' ELSE 'val' END AS split, turbine, year, step // 604800 AS segment, step,
 [1, 34 + turbine % 7, 98 + floor(power)::BIGINT % 200] AS ids FROM g WHERE power >= 20),
ms AS (SELECT turbine, t AS start, step, CASE WHEN floor(value)::BIGINT % 11 > 0 THEN cause END AS message FROM e),
th AS (SELECT ms.* FROM ms JOIN st USING (turbine, step) WHERE message IS NOT NULL),
sa AS (SELECT turbine, step, count(*) AS k, flatten(list(list_transform(string_split(message, ''), lambda c: {OFFSET} + ascii(c)) ORDER BY start, message)) AS raw, list({OFFSET} + length(message) ORDER BY start, message) AS length FROM th GROUP BY ALL),
al AS (SELECT 'tel' AS stream, '-' AS variant, source, split, turbine, year, segment, step, ids, 0 AS k, 0 AS m FROM st
 UNION ALL SELECT 'tel+status', 'raw', source, split, turbine, year, segment, step, list_concat(ids, coalesce(raw, [])), coalesce(k, 0), len(coalesce(raw, [])) FROM st LEFT JOIN sa USING (turbine, step)
 UNION ALL SELECT 'tel+status', 'length', source, split, turbine, year, segment, step, list_concat(ids, coalesce(length, [])), coalesce(k, 0), len(coalesce(length, [])) FROM st LEFT JOIN sa USING (turbine, step)),
tx AS (SELECT 'd_' || coalesce(source, '') AS source, CASE WHEN doc_id % 5 < 4 THEN 'train' ELSE 'val' END AS split, doc_id,
 list_append(list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''), lambda w: {OFFSET} + least(length(w), 90)), {JOINT}) AS ids FROM documents)"""


def mixture(T):
    """The streams of events as readings with causes as messages, and of the words of documents."""
    g = readings(T).where("power >= 20")
    step_ids = F.array(F.lit(1).cast("long"), 34 + F.col("turbine") % 7, 98 + F.floor("power") % 200)
    split = lambda c: F.when(c, "train").otherwise("val")
    steps = g.select(
        F.concat(F.lit("s"), (F.col("turbine") % 3).cast("string")).alias("source"), split(F.col("step") < UNTIL).alias("split"), "turbine", "year",
        F.expr("step div 604800").alias("segment"), "step", step_ids.alias("ids"),
    )
    said = raw(T).select("turbine", F.col("t").alias("start"), F.when(F.floor("value") % 11 > 0, F.col("cause")).alias("message"))
    words = F.transform(F.filter(F.split("text", " "), lambda w: w != ""), lambda w: F.least(F.length(w), F.lit(90)).cast("long"))
    docs = T("documents").select(
        F.concat(F.lit("d_"), F.coalesce("source", F.lit(""))).alias("source"), split(F.col("doc_id") % 5 < 4).alias("split"), F.col("doc_id").alias("doc"),
        F.concat(words, F.array(F.lit(SEPARATOR).cast("long"))).alias("ids"),
    )
    letters = lambda df: df.withColumn("ids", F.transform(F.filter(F.split("message", ""), lambda c: c != ""), lambda c: OFFSET + F.ascii(c).cast("long")))
    lengths = lambda df: df.withColumn("ids", F.array(OFFSET + F.length("message").cast("long")))
    return M.build_mixture(
        steps, said, docs, new_folder(g.sparkSession, "mixture"), {"raw": letters, "length": lengths}, step_of=lambda t: t - t % HOUR,
        context=CONTEXT, stride=STRIDE, text_offset=OFFSET, separator=SEPARATOR, joint_separator=JOINT,
    )


@query("mixture_tallies", f"""WITH {STEPS}, o AS (SELECT *, len(ids) AS n, coalesce(sum(len(ids)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o, sum(len(ids)) OVER (PARTITION BY stream, variant, source, split, turbine, year, segment) AS total, row_number() OVER w - 1 AS i
 FROM al WINDOW w AS (PARTITION BY stream, variant, source, split, turbine, year, segment ORDER BY step))
SELECT stream, variant, source, split, sum(n)::BIGINT AS tokens, count(*) AS steps, sum(k)::BIGINT AS messages, sum(m)::BIGINT AS message_tokens, count(*) FILTER (i % {STRIDE} = 0 AND o + {CONTEXT} <= total) AS windows FROM o GROUP BY ALL
UNION ALL SELECT 'txt', '-', source, split, sum(len(ids))::BIGINT, 0, 0, 0, greatest(0, sum(len(ids)) - {CONTEXT - 1})::BIGINT FROM tx GROUP BY ALL""")
def mixture_tallies(T):
    """Tokens, steps, messages and windows of every shard of the mixture, once its files hold what was to be written."""
    return mixture(T)["tallies"]


def powers_sql(bits: int) -> str:
    """pw: i, x, y: both bases to the power of i, for i under 2 ** bits, by doubling."""
    parts = ["pw0 AS (SELECT 0::BIGINT AS i, 1::BIGINT AS x, 1::BIGINT AS y)"]
    for k in range(bits):
        x, y = (pow(b, 1 << k, m) for b, m in zip(M.BASES, M.MODULI, strict=True))
        parts.append(f"pw{k + 1} AS MATERIALIZED (SELECT * FROM pw{k} UNION ALL SELECT i + {1 << k}, x * {x} % {M.MODULI[0]}, y * {y} % {M.MODULI[1]} FROM pw{k})")
    return ", ".join(parts) + f", pw AS (SELECT * FROM pw{bits})"


@query("mixture_digests", f"""WITH {STEPS}, {powers_sql(21)}, fl AS (SELECT stream, variant, source, split, flatten(list(ids ORDER BY turbine, year, segment, step)) AS t FROM al GROUP BY ALL UNION ALL SELECT 'txt', '-', source, split, flatten(list(ids ORDER BY doc_id)) FROM tx GROUP BY ALL),
u AS (SELECT stream, variant, source, split, unnest(t) AS v, unnest(range(0, len(t))) AS i FROM fl)
SELECT stream, variant, source, split, count(*) AS tokens, printf('%08x%08x', (sum((v + 1) * x % {M.MODULI[0]}) % {M.MODULI[0]})::BIGINT, (sum((v + 1) * y % {M.MODULI[1]}) % {M.MODULI[1]})::BIGINT) AS digest FROM u JOIN pw USING (i) GROUP BY ALL""")
def mixture_digests(T):
    """Digests of the mixture's streams, taken from the files chunk by chunk."""
    out = mixture(T)
    found = None
    for name in ("tel", "tel+status_raw", "tel+status_length", "txt"):
        stream, _, variant = name.partition("_")
        told = M.stream_digests(out[name], M.SHARD).select(F.lit(stream).alias("stream"), F.lit(variant or "-").alias("variant"), *M.SHARD, "tokens", "digest")
        found = told if found is None else found.union(told)
    return found
