"""Ranks and running sums of rows in the order of a value, without a group in one task.

A group's order is cut into leaves of at most so many rows: ranges of the
value, and where one value has more rows than that, ranges of the tie. Sums are
made per leaf, accumulated over leaves, and finished inside each leaf. Groups
that fit one leaf need no cutting.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import _leaf, _magnitude
from .tables import forget, written

LEAF = 1 << 16


def _kind(x: Column, descending: bool) -> Column:
    """Where values that aren't finite numbers stand among the others: nulls and NaN as Spark orders them."""
    places = ("4", "3", "2", "1", "0") if descending else ("0", "1", "2", "3", "4")
    null, low, finite, high, nan = places
    return F.when(x.isNull(), null).when(F.isnan(x), nan).when(x == float("-inf"), low).when(x == float("inf"), high).otherwise(finite)


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return out


def _cut(rows: DataFrame, by: list[str], leaf: int) -> DataFrame:
    """rows(by, _kind, _x, _t) with _path: leaves in rising order of kind, x and t, none over leaf rows unless all of it is alike."""
    keys = [*by, "_path"]
    rows = rows.withColumn("_path", F.col("_kind"))
    old = None
    for level in range(16):
        size = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *[f(c).alias(f"{f.__name__}{c}") for c in ("_x", "_t") for f in (F.min, F.max)])
        large = size.where((F.col("_n") > leaf) & ((F.col("min_x") < F.col("max_x")) | (F.col("min_t") < F.col("max_t"))))
        large = written(large, "leaves")
        if not large.limit(1).count():
            forget(large)
            return rows
        ends = [F.col(f"b.{c}") for c in ("min_x", "max_x", "min_t", "max_t")]
        x = (_magnitude(F.col("a._x")), *map(_magnitude, ends[:2])) if level % 8 == 0 else (F.col("a._x"), *ends[:2])
        place = F.when(ends[0] < ends[1], _leaf(*x)).otherwise(_leaf(F.col("a._t"), *ends[2:]))
        joined = rows.alias("a").join(large.alias("b"), _same(rows, large, keys), "left")
        path = F.when(F.col("b._n").isNotNull(), F.concat("a._path", F.lpad(place.cast("string"), 4, "0"))).otherwise(F.col("a._path"))
        rows = written(joined.select(*[f"a.{c}" for c in rows.columns if c != "_path"], path.alias("_path")), "ranked")
        forget(*[t for t in (old, large) if t is not None])
        old = rows
    return rows


def running(df: DataFrame, by: Sequence[str], value: str, tie: str, sums: Mapping[str, Column] | None = None, descending: bool = False, leaf: int = LEAF) -> DataFrame:
    """df with rank (from 1 on) and, per name of sums, the sum over the rows up to and with this one, in the order of value, then of tie.

    Nulls and NaN stand where Spark puts them: nulls first and NaN last, or the
    other way round if descending. A tie that is no number is ordered by its
    md5. Rows that agree in both stand in any order. Null keys are keys.
    """
    by, sums = list(by), dict(sums or {})
    number = isinstance(df.schema[tie].dataType, T.NumericType)
    x = F.col(value).cast("double")
    last = F.col(tie) if number else F.md5(F.col(tie).cast("string").cast("binary"))
    coarse = F.col(tie).cast("double") if number else F.conv(F.substring(F.md5(F.col(tie).cast("string").cast("binary")), 1, 12), 16, 10).cast("double")
    kind = _kind(x, descending)
    finite = F.when(kind == "2", -x if descending else x).otherwise(0.0)
    rows = df.withColumns({"_kind": kind, "_x": finite, "_t": F.coalesce(F.nanvl(coarse, F.lit(0.0)), F.lit(0.0)), **{f"_s_{k}": c for k, c in sums.items()}})
    largest = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    order = ["_kind", "_x", F.col(value).desc() if descending else F.col(value).asc(), last.asc_nulls_first()]
    added = {"rank": F.lit(1), **{k: F.col(f"_s_{k}") for k in sums}}
    if largest <= leaf:
        w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return rows.withColumns({k: F.sum(c).over(w) for k, c in added.items()}).drop("_kind", "_x", "_t", *[f"_s_{k}" for k in sums])
    rows = _cut(written(rows, "ranked"), by, leaf)
    before = W.partitionBy(*by).orderBy("_path").rowsBetween(W.unboundedPreceding, -1)
    leaves = rows.groupBy(*by, "_path").agg(*[F.sum(c).alias(f"_b_{k}") for k, c in added.items()])
    leaves = leaves.withColumns({f"_b_{k}": F.coalesce(F.sum(f"_b_{k}").over(before), F.lit(0)) for k in added})
    inside = W.partitionBy(*by, "_path").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({f"_i_{k}": F.sum(c).over(inside) for k, c in added.items()})
    joined = rows.alias("a").join(leaves.alias("b"), _same(rows, leaves, [*by, "_path"]))
    return joined.select(*[f"a.{c}" for c in df.columns], *[(F.col(f"a._i_{k}") + F.col(f"b._b_{k}")).alias(k) for k in added])


def part_of(rank: Column, n: Column, parts: int) -> Column:
    """The part (from 1 on) of the row of a rank among n when rows go into parts of equal sizes, larger ones first."""
    size, more = F.floor(n / parts), n % parts
    wide = more * (size + 1)
    return F.when(rank <= wide, F.ceil(rank / (size + 1))).otherwise(more + F.ceil((rank - wide) / F.greatest(size, F.lit(1)))).cast("int")
