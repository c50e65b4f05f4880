"""Exact order statistics of many groups at once, by refinement of ranges of values.

Rows are counted per distinct value first, so a value that most rows have is
one row. A group's range is cut into PARTS leaves, and rows are counted per leaf;
only leaves in which a wanted rank falls are cut again, until they hold one
value. The first cut is by magnitude, later ones are linear, so that a leaf's
width falls by the factor PARTS each time, whatever the distribution: a handful
of rounds settles all doubles, and from the second on few rows are left.

No task holds a group: it holds counts of at most PARTS leaves and the ranks
that are wanted in one leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import forget, written

PARTS = 1024


def count_values(values: DataFrame) -> DataFrame:
    """group, value, n: finite values of values(group, value) with their rows, 0.0 and -0.0 as one."""
    value = F.col("value").cast("double")
    finite = values.select("group", (value + 0.0).alias("value")).where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    return finite.groupBy("group", "value").agg(F.count("*").alias("n"))


def totals(counted: DataFrame) -> DataFrame:
    """group, rows, low, high, n_values."""
    return counted.groupBy("group").agg(F.sum("n").alias("rows"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n_values"))


def _magnitude(v: Column) -> Column:
    """Rises with v; even over all doubles."""
    return F.signum(v) * (F.log2(F.when(v != 0, F.abs(v)).otherwise(F.lit(1.0))) + 1075)


def _leaf(x: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, F.least(F.lit(PARTS - 1), F.floor((x - low) / (high - low) * PARTS))).otherwise(0).cast("int")


def order_statistics(counted: DataFrame, wanted: DataFrame) -> DataFrame:
    """group, rank, value: the value at each wanted(group, rank), ranks from 0 on in rising order of value.

    counted(group, value, n) as of count_values(), each value once per group. A
    rank that a group doesn't have, and groups without values, give no row;
    repeated ranks count once. A null group is a group like others.
    """
    wanted = written(wanted.select("group", F.col("rank").cast("long").alias("rank")).where("rank >= 0").distinct(), "ranks")
    ends = written(totals(counted).select("group", F.col("low").alias("lo"), F.col("high").alias("hi"), F.lit(0).cast("long").alias("base"), "rows"), "ranks")
    rows, spent, found = counted.select("group", "value", "n"), [], []
    live = ends.join(wanted.withColumnRenamed("group", "_g").select("_g").distinct(), F.col("group").eqNullSafe(F.col("_g"))).drop("_g")
    asked = wanted.alias("w").join(ends.alias("e"), F.col("w.group").eqNullSafe(F.col("e.group")) & (F.col("rank") < F.col("rows"))).select("e.group", "lo", "rank")
    placed = rows.alias("r").join(live.alias("l"), F.col("r.group").eqNullSafe(F.col("l.group"))).select("l.group", "value", "n", "lo", "hi", "base")
    first = True
    while True:
        x, lo, hi = [_magnitude(F.col(c)) if first else F.col(c) for c in ("value", "lo", "hi")]
        placed = placed.withColumn("leaf", _leaf(x, lo, hi))
        leaves = placed.groupBy("group", "lo", "base", "leaf").agg(F.sum("n").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
        here = W.partitionBy("group", "lo").orderBy("leaf").rowsBetween(W.unboundedPreceding, -1)
        leaves = leaves.withColumn("start", F.col("base") + F.coalesce(F.sum("n").over(here), F.lit(0)))
        # the last leaf that starts at or before a rank: one window over both, no pairs
        leaf = F.struct("leaf", "start", "n", "least", "most")
        both = leaves.select("group", "lo", F.col("start").alias("at"), F.lit(0).alias("side"), leaf.alias("x")).unionByName(
            asked.select("group", "lo", F.col("rank").alias("at"), F.lit(1).alias("side")), allowMissingColumns=True
        )
        upto = W.partitionBy("group", "lo").orderBy("at", "side").rowsBetween(W.unboundedPreceding, W.currentRow)
        both = both.withColumn("x", F.last("x", ignorenulls=True).over(upto)).where("side = 1")
        got = written(both.select("group", "lo", F.col("at").alias("rank"), "x.*"), "ranks")
        found.append(got.where("least = most").select("group", "rank", F.col("least").alias("value")))
        asked = got.where("least < most").select("group", F.col("least").alias("lo"), "rank")
        spent.append(got)
        if not asked.limit(1).count():
            break
        open_leaves = written(got.where("least < most").select("group", F.col("lo").alias("_lo"), F.col("leaf").alias("_leaf"), F.col("least"), F.col("most"), "start").distinct(), "ranks")
        spent.append(open_leaves)
        on = F.col("p.group").eqNullSafe(F.col("o.group")) & (F.col("lo") == F.col("_lo")) & (F.col("leaf") == F.col("_leaf"))
        kept = placed.alias("p").join(open_leaves.alias("o"), on)
        placed = written(kept.select("p.group", "value", "n", F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("start").alias("base")), "ranks")
        spent.append(placed)
        first = False
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    out = written(out, "ranks")
    forget(*spent, wanted, ends)
    return out


def quantiles(counted: DataFrame, shares: DataFrame) -> DataFrame:
    """group, share, quantile for shares(group, share), by linear interpolation between neighbouring ranks; no row for a group without values."""
    sizes = counted.groupBy("group").agg(F.sum("n").alias("rows"))
    place = F.col("share") * (F.col("rows") - 1)
    at = F.floor(place).cast("long")
    asked = shares.alias("s").join(sizes.alias("z"), F.col("s.group").eqNullSafe(F.col("z.group"))).select(
        "z.group", "share", at.alias("at"), F.least(at + 1, F.col("rows") - 1).alias("after"), (place - at).alias("part")
    )
    asked = written(asked, "shares")
    ranks = order_statistics(counted, asked.select("group", F.explode(F.array("at", "after")).alias("rank")))
    same = lambda a, r: F.col("a.group").eqNullSafe(F.col("r.group")) & (F.col(a) == F.col("r.rank"))
    lower = asked.alias("a").join(ranks.alias("r"), same("at", "r")).select("a.*", F.col("r.value").alias("here"))
    both = lower.alias("a").join(ranks.alias("r"), same("after", "r"))
    return both.select("a.group", "share", (F.col("here") + F.col("part") * (F.col("r.value") - F.col("here"))).alias("quantile"))


def slots(counted: DataFrame, cuts: DataFrame) -> DataFrame:
    """group, slot, n, least, most: rows of counted by the number of cuts at most their value.

    cuts(group, cuts array<double>) has one row per group, a bounded array;
    a group without one, or with a null, has one slot.
    """
    own = cuts.select(F.col("group").alias("_g"), "cuts")
    rows = counted.join(own, F.col("group").eqNullSafe(F.col("_g")), "left")
    slot = F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("value"))), F.lit(0))
    return rows.groupBy("group", F.greatest(slot, F.lit(0)).alias("slot")).agg(F.sum("n").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
