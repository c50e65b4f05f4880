"""Ranks over leaves against a plain sort, and statistics that use them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import metrics, ranks


def rows_of(seed=2):
    rng = random.Random(seed)
    odd = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 1e300, -1e-300]
    rows = []
    for k in range(900):
        group = rng.choice(["a", "a", "b", None])
        rows.append((group, rng.choice([rng.random(), 0.5, 0.5, rng.choice(odd), 2.0 ** rng.randint(-40, 40)]), k * 7919 % 900, rng.randint(0, 3)))
    return rows


def spark_order(value, descending):
    """Key that sorts as Spark does: nulls first, NaN last; the reverse if descending."""
    if value is None:
        key = (0, 0.0)
    elif math.isnan(value):
        key = (2, 0.0)
    else:
        key = (1, value)
    return (-key[0], -key[1]) if descending else key


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("leaf", [10_000, 40, 3])
def test_ranks_and_sums_match_a_sort(spark, descending, leaf):
    rows = rows_of()
    df = spark.createDataFrame(rows, "g string, v double, k long, n long").repartition(3)
    got = {(r["g"], r["k"]): (r["rank"], r["total"]) for r in ranks.running(df, ["g"], "v", "k", {"total": F.col("n")}, descending, leaf).collect()}
    want = {}
    for group in ("a", "b", None):
        total = 0
        for rank, (_, v, k, n) in enumerate(sorted((r for r in rows if r[0] == group), key=lambda r: (spark_order(r[1], descending), r[2])), 1):
            total += n
            want[group, k] = (rank, total)
    assert got == want


def test_text_ties_give_each_rank_once(spark):
    df = spark.createDataFrame([(1.0, f"k{i}") for i in range(300)], "v double, k string")
    few, many = ({r["k"]: r["rank"] for r in ranks.running(df, [], "v", "k", leaf=leaf).collect()} for leaf in (7, 1000))
    assert few == many and sorted(few.values()) == list(range(1, 301))


def test_parts_are_those_of_ntile(spark):
    for n in (1, 4, 7, 23):
        df = spark.range(1, n + 1).select(F.col("id").alias("rank"), F.lit(n).cast("long").alias("n"))
        sql = df.select("rank", F.ntile(5).over(__import__("pyspark.sql").sql.Window.orderBy("rank")).alias("want"), ranks.part_of(F.col("rank"), F.col("n"), 5).alias("got"))
        assert sql.where("want <> got").count() == 0


def test_statistics_are_the_same_over_small_leaves(spark):
    rng = random.Random(1)
    rows = [(k % 3, k, rng.choice([0.1, 0.2, rng.random()]), rng.random() < 0.4) for k in range(400)]
    df = spark.createDataFrame(rows, "g long, k long, p double, label boolean").withColumns({"confidence": F.abs(F.col("p") - 0.5), "error": (F.col("p") > 0.5) != F.col("label")})
    told = lambda x: sorted(map(tuple, x.collect()))
    assert told(metrics.risk_coverage(df, ["g"], "k", leaf=9).select("k", "rank", "risk")) == told(metrics.risk_coverage(df, ["g"], "k").select("k", "rank", "risk"))
    for by in (["g"], []):
        small, whole = (told(metrics.equal_mass_table(df, 6, by, "k", leaf=leaf).select(*by, "bin", "n", F.round("mean_p", 9), F.round("mean_y", 9))) for leaf in (11, 10_000))
        assert small == whole


def test_no_rows_no_ranks(spark):
    empty = spark.createDataFrame([], "g string, v double, k long")
    assert ranks.running(empty, ["g"], "v", "k", leaf=2).count() == 0
