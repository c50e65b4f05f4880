"""Queries of windows over streams: flags, mask places, persistence, checked joins, samples of groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluated as E
from ..operators import samplers
from ..operators import shards as H
from ..operators import windows as N
from .registry import HOUR, READ, query, raw, readings
from .shard_queries import STEPS

# a step is three tokens and, as its message, what is left of it
TAILS = f"""{STEPS}, w AS (SELECT a.conv_id, a.step, a."offset", a.size, a."offset" + a.size AS stop, (SELECT min(b.step) FROM sp b WHERE b.conv_id = a.conv_id AND b."offset" >= a."offset" + a.size - 10) AS fit, (SELECT min(b.step) FROM sp b WHERE b.conv_id = a.conv_id AND b.step > a.step - 3) AS early FROM sp a),
c AS (SELECT w.*, greatest(fit, early) AS s0, coalesce(greatest(fit, early) > step, true) OR fit IS NULL AS head_cut FROM w),
tw AS (SELECT c.conv_id, c.step, stop, CASE WHEN head_cut THEN stop - 10 ELSE (SELECT b."offset" FROM sp b WHERE b.conv_id = c.conv_id AND b.step = s0) END AS first FROM c),
ms AS (SELECT sp.conv_id, sp.step, sp."offset" + 3 AS opens, sp."offset" + sp.size AS closes FROM sp JOIN conversations t ON t.conv_id = sp.conv_id AND t.turn = sp.step WHERE sp.size > 3 AND t.role = 'user' AND length(t.text) % 3 > 0)"""


def conversation_windows(T):
    """Steps of conversations as streams, and the tail-anchored window of each."""
    s = T("conversations").select("conv_id", F.col("turn").alias("step"), (3 + F.length("text") % 9).cast("long").alias("size"), "role", F.length("text").alias("n"))
    s = H.running_offsets(s, ["conv_id"], "step", F.col("size"))
    tails = H.tail_anchored(s.drop("role", "n"), ["conv_id"], 3, 10, 3).select("conv_id", F.col("step").alias("end_step"), "first", "length")
    return s, tails


@query("window_flags", f"""WITH {TAILS} SELECT conv_id, step AS end_step, EXISTS (SELECT 1 FROM ms WHERE ms.conv_id = tw.conv_id AND ms.opens < tw.stop AND ms.closes > tw.first) AS capped, EXISTS (SELECT 1 FROM ms WHERE ms.conv_id = tw.conv_id AND ms.step BETWEEN tw.step - 2 AND tw.step) AS uncapped FROM tw""")
def window_flags(T):
    """Whether a flagged message is inside each window, capped by its tokens or not, by two counts."""
    s, tails = conversation_windows(T)
    flag = (F.col("role") == "user") & (F.col("n") % 3 > 0)
    messages = s.where("size > 3").select("conv_id", (F.col("offset") + 3).alias("opens"), (F.col("offset") + F.col("size")).alias("closes"), "step", flag.alias("flag"))
    return N.flagged_windows(tails, messages, ["conv_id"], 3).select("conv_id", "end_step", "capped", "uncapped")


@query("mask_places", f"""WITH {TAILS}, pl AS (SELECT tw.conv_id, tw.step, sp."offset" + c - tw.first AS place, tw.stop - tw.first AS n FROM tw JOIN sp USING (conv_id), (SELECT unnest([1, 2]) AS c) WHERE sp."offset" + c - tw.first BETWEEN 0 AND tw.stop - tw.first - 1)
SELECT tw.conv_id, tw.step AS end_step, coalesce((SELECT string_agg(place::BIGINT::VARCHAR, ',' ORDER BY place) FROM pl WHERE pl.conv_id = tw.conv_id AND pl.step = tw.step), '') AS places FROM tw""")
def mask_places(T):
    """Where two masked channels of each step stand in windows that may begin inside a step."""
    s, tails = conversation_windows(T)
    found = N.mask_places(tails, s.select("conv_id", "offset"), ["conv_id"], [1, 2], 3, 16)
    return found.select("conv_id", "end_step", F.array_join(F.transform("places", lambda x: x.cast("string")), ",").alias("places"))


@query("persistence_features", f"""WITH {READ}, f AS (SELECT turbine, t FROM e WHERE cause = 'error'), v AS (SELECT turbine, t FROM e WHERE cause = 'view' AND value >= 50),
a AS (SELECT g.turbine, g.step, f.t AS last FROM g ASOF LEFT JOIN f ON g.turbine = f.turbine AND g.step >= f.t), b AS (SELECT a.*, v.t AS stop FROM a ASOF LEFT JOIN v ON a.turbine = v.turbine AND a.step >= v.t)
SELECT turbine, step, CASE WHEN step - last < 86400 THEN 1.0 ELSE 0.0 END::DOUBLE AS p1, round(-least(coalesce((step - last) / 3600.0, 48), 48), 6)::DOUBLE AS p2, CASE WHEN step - stop < 86400 THEN 1.0 ELSE 0.0 END::DOUBLE AS p3, coalesce(step - last < 21600, false) AS within_21600 FROM b""")
def persistence_features(T):
    """What is known of a step without a model: recent events, hours since the last, recent stops; one order for all."""
    e = raw(T)
    events = e.where("cause = 'error'").select("turbine", F.col("t").alias("step"))
    stops = e.where("cause = 'view' and value >= 50").select("turbine", F.col("t").alias("step"))
    out = N.persistence(readings(T).select("turbine", "step"), events, stops, ["turbine"], "step", 24 * HOUR, 48.0, [6 * HOUR])
    return out.withColumn("p2", F.round("p2", 6))


@query("sample_per_group", """SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) <= 5""")
def sample_per_group(T):
    """Five documents of each source by keyed hashes; tasks keep five a group before the shuffle."""
    return samplers.bottom_k(T("documents").select("source", "doc_id"), ["source"], "doc_id", 5, 7)


@query("evaluated_rows", f"""WITH {READ} SELECT turbine, step, power, power > 100 AS y, n, CASE WHEN n > 1 THEN n % 2 = 0 ELSE false END AS z, n > 1 AS z_known FROM g""")
def evaluated_rows(T):
    """Scores of steps joined to their index with equal labels and a second one, each row once on both sides or an error."""
    g = readings(T)
    scores = g.select("turbine", "step", "power", (F.col("power") > 100).alias("y"))
    known = F.col("n") > 1
    index = readings(T).select("turbine", "step", (F.col("power") > 100).alias("y"), "n", F.when(known, F.col("n") % 2 == 0).alias("z"), known.alias("z_known"))
    joined = E.evaluated_rows(scores, index.select("turbine", "step", "y", "n"), ["turbine", "step"], {"y": "y"})
    return E.relabelled(joined, index, ["turbine", "step"], "y", "z")
