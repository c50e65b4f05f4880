"""Queries in the shapes of joins, sets, pivots and top-k that the pipelines use, on the star schema."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .registry import query


@query("pricing_summary", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing(T):
    x = T("lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"),
    )


@query("revenue_by_nation", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def revenue(T):
    x = T("lineitem").join(T("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(T("customer"), F.col("o_custkey") == F.col("c_custkey"))
    x = x.join(T("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(T("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("full_outer", """WITH a AS (SELECT o_custkey AS k, count(*) AS orders FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS open FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT k, orders, open FROM a FULL JOIN b USING (k)""")
def full_outer(T):
    """Sibling tables side by side, rows of either kept."""
    o = T("orders")
    side = lambda s, n: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias(n))
    return side("F", "orders").join(side("O", "open"), "k", "full")


@query("left_join_indicator", "SELECT c_custkey, o.o_custkey IS NOT NULL AS matched FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) o ON c_custkey = o_custkey")
def indicator(T):
    o = T("orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("hit")).distinct()
    return T("customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("hit", F.lit(False)).alias("matched"))


@query("left_first_match", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def first_match(T):
    o = T("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("o_orderkey"))
    return T("customer").select("c_custkey").join(o, "c_custkey", "left")


@query("semi_anti", "SELECT c_mktsegment, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS with_orders, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders)) AS without FROM customer GROUP BY 1")
def semi_anti(T):
    c, o = T("customer"), T("orders").select(F.col("o_custkey").alias("c_custkey"))
    a = c.join(o, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("with_orders"))
    b = c.join(o, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("without"))
    return a.join(b, "c_mktsegment", "full").fillna(0, ["with_orders", "without"])


@query("pivot_crosstab", "SELECT extract(year FROM o_orderdate)::INT AS year, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def pivot(T):
    x = T("orders").groupBy(F.year("o_orderdate").alias("year")).pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)
    return x.withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


@query("unpivot_long", "SELECT p_partkey, 'p_size' AS channel, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def unpivot(T):
    from ..operators.profile import to_long

    return to_long(T("part"), ["p_partkey"], ["p_size", "p_retailprice"])


@query("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def grouping_sets(T):
    x = T("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))
    return x


@query("top_k_per_group", "SELECT c_mktsegment, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 3")
def top_k(T):
    w = W.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return T("customer").select("c_mktsegment", "c_custkey", "c_acctbal", F.row_number().over(w).alias("n")).where("n <= 3").drop("n")


@query("arg_min_choice", "SELECT user_id, n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ORDER BY n DESC, user_id LIMIT 1")
def choose(T):
    """The user with most events, the smallest id of ties."""
    return T("events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(1)


@query("set_operations", """SELECT 'union' AS op, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 UNION SELECT l_partkey FROM lineitem WHERE l_discount > 0.08)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.08)
UNION ALL SELECT 'except', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.08)""")
def set_operations(T):
    l = T("lineitem")
    a, b = l.where("l_quantity > 45").select("l_partkey"), l.where("l_discount > 0.08").select("l_partkey")
    count = lambda df, op: df.agg(F.lit(op).alias("op"), F.count("*").alias("n"))
    return count(a.union(b).distinct(), "union").union(count(a.intersect(b), "intersect")).union(count(a.subtract(b), "except"))


@query("daily_agreement", """WITH d AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT o_orderdate::DATE AS day, count(*) FILTER (o_totalprice > 1000) AS n FROM orders GROUP BY 1)
SELECT count(*) AS days, round(avg((abs(d.n - p.n) <= 1)::INT), 9) AS agree FROM d JOIN p USING (day) WHERE d.n > 0 OR p.n > 0""")
def agreement(T):
    o = T("orders").withColumn("day", F.to_date("o_orderdate"))
    d = o.groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 1000).alias("m"))
    return d.agg(F.count("*").alias("days"), F.round(F.avg((F.abs(F.col("n") - F.col("m")) <= 1).cast("double")), 9).alias("agree"))


@query("bucket_histogram", "SELECT (p_size // 10)::INT AS bucket, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1")
def histogram(T):
    return T("part").groupBy(F.floor(F.col("p_size") / 10).cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("brands"))


@query("supplier_ranges", "SELECT n_name, count(*) AS n, min(s_acctbal) AS low, max(s_acctbal) AS high, round(quantile_cont(s_acctbal, 0.5), 6) AS median FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def suppliers(T):
    x = T("supplier").join(F.broadcast(T("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return x.groupBy("n_name").agg(F.count("*").alias("n"), F.min("s_acctbal").alias("low"), F.max("s_acctbal").alias("high"), F.round(F.percentile("s_acctbal", F.lit(0.5)), 6).alias("median"))
