"""Flags, masks and persistence of windows over streams of tokens and steps.

What lies before a place of a stream is counted by sums over leaves (ranges of
places) and inside one leaf, so a stream is never in one task, and windows of
any length cost two look-ups, not a join of their ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAF = 1 << 16


def count_before(points: DataFrame, marks: DataFrame, keys: Sequence[str], at: str, mark_at: str, name: str, inclusive: bool = False, leaf: int = LEAF) -> DataFrame:
    """points with name: how many marks of its keys lie before at (or at it too, if inclusive). Places are whole numbers; null ones count nothing."""
    keys = list(keys)
    # a mark at a place stands behind the points of it, or before them if inclusive
    side = F.lit(0 if inclusive else 2)
    rows = points.withColumns({"_at": F.col(at).cast("long"), "_side": F.lit(1), "_one": F.lit(0)})
    told = marks.where(F.col(mark_at).isNotNull()).select(*keys, F.col(mark_at).cast("long").alias("_at"), side.alias("_side"), F.lit(1).alias("_one"))
    both = rows.unionByName(told, allowMissingColumns=True).withColumn("_leaf", F.floor(F.col("_at") / leaf))
    sums = both.groupBy(*keys, "_leaf").agg(F.sum("_one").alias("_sum"))
    earlier = W.partitionBy(*keys).orderBy("_leaf").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = W.partitionBy(*keys, "_leaf").orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = both.withColumn("_in", F.sum("_one").over(inside)).where("_side = 1")
    on = F.lit(True)
    for k in [*keys, "_leaf"]:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = both.alias("a").join(sums.alias("b"), on)
    count = F.when(F.col("a._at").isNull(), 0).otherwise(F.col("a._in") + F.col("b._base"))
    return joined.select(*[f"a.{c}" for c in points.columns], count.cast("long").alias(name))


def flagged_windows(windows: DataFrame, messages: DataFrame, keys: Sequence[str], context_steps: int, leaf: int = LEAF) -> DataFrame:
    """windows(keys, end_step, first, length) with capped and uncapped.

    messages(keys, opens, closes, step, flag) are in a stream at places opens to
    closes (behind their last token), none inside another, and follow a step.
    capped: a flagged message has a token in first to first + length. uncapped:
    one follows any of the context_steps steps up to end_step.
    """
    keys = list(keys)
    told = messages.where("flag").select(*keys, "opens", "closes", F.col("step").alias("_step"))
    rows = windows.withColumns({"_last": F.col("first") + F.col("length"), "_low": F.col("end_step") - (context_steps - 1)})
    rows = count_before(rows, told, keys, "_last", "opens", "_begun", leaf=leaf)
    rows = count_before(rows, told, keys, "first", "closes", "_over", inclusive=True, leaf=leaf)
    rows = count_before(rows, told, keys, "end_step", "_step", "_upto", inclusive=True, leaf=leaf)
    rows = count_before(rows, told, keys, "_low", "_step", "_under", leaf=leaf)
    flags = {"capped": (F.col("length") > 0) & (F.col("_begun") > F.col("_over")), "uncapped": F.col("_upto") > F.col("_under")}
    return rows.withColumns(flags).select(*windows.columns, *flags)


def attached_stops(stream: DataFrame, codes: Sequence[str], stop_status: str, step: int) -> DataFrame:
    """turbine, at: stop rows of listed codes at their start rounded up to the grid; stream has turbine, start, code, status."""
    chosen = stream.where((F.col("status") == stop_status) & F.col("code").cast("string").isin(*map(str, codes)) & F.col("start").isNotNull())
    return chosen.select("turbine", (F.ceil(F.col("start") / step) * step).cast("long").alias("at"))


def mask_places(windows: DataFrame, steps: DataFrame, keys: Sequence[str], channels: Sequence[int], per_step: int, size: int = 4096) -> DataFrame:
    """windows(keys, first, length) with places: where in the window the masked channels of its steps stand, rising.

    steps(keys, offset) begin at offset; a channel's place in a step is one of
    channels, less than per_step. A step that begins before a window adds those
    of its places that reach into it. Windows meet steps by equal stretches of
    size places. A window without any has an empty array.
    """
    keys = list(keys)
    rows = windows.withColumn("_w", F.struct(*windows.columns))
    low, last = F.col("first") - (per_step - 1), F.col("first") + F.col("length") - 1
    stretch = lambda c: F.floor(c / size).cast("long")
    probe = rows.where("length > 0").select("_w", *keys, "first", "length", F.explode(F.sequence(stretch(low), stretch(last))).alias("_s"))
    near = probe.join(steps.select(*keys, F.col("offset").alias("_o"), stretch(F.col("offset")).alias("_s")), [*keys, "_s"])
    places = near.select("_w", "length", F.explode(F.transform(F.array(*[F.lit(c) for c in channels]), lambda c: F.col("_o") - F.col("first") + c)).alias("place"))
    found = places.where((F.col("place") >= 0) & (F.col("place") < F.col("length"))).groupBy("_w").agg(F.array_sort(F.collect_set("place")).alias("places"))
    joined = rows.alias("a").join(found.alias("b"), F.col("a._w").eqNullSafe(F.col("b._w")), "left")
    return joined.select(*[f"a.{c}" for c in windows.columns], F.coalesce("places", F.array().cast("array<bigint>")).alias("places"))


def mask_window(tokens: Column, places: Column, missing: int, values_below: int, structural: Sequence[int] = ()) -> Column:
    """tokens with the missing id at places; a token there that is no value (from values_below on, or structural) is an error that names it."""
    hit = lambda i: F.array_contains(places, i.cast("long"))
    value = lambda x: (x < values_below) & ~x.isin(*structural) if structural else x < values_below
    refuse = lambda x: F.raise_error(F.concat(F.lit("no value token: "), x.cast("string"))).cast("long")
    return F.transform(tokens, lambda x, i: F.when(hit(i), F.when(value(x), F.lit(missing).cast("long")).otherwise(refuse(x))).otherwise(x.cast("long")))


def last_times(rows: DataFrame, sides: Mapping[str, DataFrame], keys: Sequence[str], time: str) -> DataFrame:
    """rows with a column per side: the side's last time at or before the row's. One order serves all sides; a side has keys and time."""
    keys = list(keys)
    both = rows.withColumn("_row", F.lit(True)).withColumns({f"_{name}": F.lit(None).cast("long") for name in sides})
    for name, side in sides.items():
        told = side.where(F.col(time).isNotNull()).select(*keys, F.col(time), F.col(time).cast("long").alias(f"_{name}"))
        both = both.unionByName(told, allowMissingColumns=True)
    upto = W.partitionBy(*keys).orderBy(time).rangeBetween(W.unboundedPreceding, 0)
    return both.withColumns({name: F.max(f"_{name}").over(upto) for name in sides}).where("_row").select(*rows.columns, *sides)


def persistence(rows: DataFrame, events: DataFrame, stops: DataFrame, keys: Sequence[str], time: str, look: int, cap: float, spans: Sequence[int] = (), hour: int = 3600) -> DataFrame:
    """rows with p1, p2, p3 and within_<span>: what a rule without a model knows of a row.

    p1: an event began in (t - look, t]; p2: minus the hours since the last
    event, at most cap of them, also where there was none; p3: as p1 for stops;
    within_<span>: as p1 for other spans of seconds. Events and stops have keys and time.
    """
    held = last_times(rows, {"_event": events, "_stop": stops}, keys, time)
    since = lambda c: F.col(time).cast("long") - F.col(c)
    within = lambda c, span: F.coalesce(since(c) < span, F.lit(False))
    hours = F.least(F.coalesce(since("_event") / hour, F.lit(float(cap))), F.lit(float(cap)))
    out = {"p1": within("_event", look).cast("double"), "p2": -hours, "p3": within("_stop", look).cast("double")}
    out |= {f"within_{s}": within("_event", s) for s in spans}
    return held.withColumns(out).drop("_event", "_stop")
