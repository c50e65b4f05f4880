import math

from pyspark.sql import functions as F

from gridloom.functions import scalars as S
from gridloom.operators import islands, splits, telemetry, temporal


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_touching_intervals_merge_and_nested_are_absorbed(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 10, 20), ("a", 12, 15), ("a", 30, 40), ("b", 5, 5), ("b", 7, None)], "k string, start long, end long")
    assert rows(islands.interval_union(df, ["k"], "start", "end"), "k", "start", "end") == [("a", 0, 20), ("a", 30, 40)]


def test_allocation_splits_seconds_over_steps(spark):
    df = spark.createDataFrame([("a", 550, 1250)], "k string, start long, end long")
    assert rows(islands.allocate(df, ["k"], "start", "end"), "step", "seconds") == [(0, 50), (600, 600), (1200, 50)]


def test_grid_is_anchored_at_the_first_stamp(spark):
    df = spark.createDataFrame([("a", 3, 1.0), ("a", 13, 2.0), ("a", 17, 9.0), ("a", 33, 4.0)], "k string, t long, v double")
    assert rows(islands.regular_grid(df, ["k"], "t", 10).fillna(-1.0), "t", "v") == [(3, 1.0), (13, 2.0), (23, -1.0), (33, 4.0)]


def test_impute_fills_short_interior_runs_by_row_position(spark):
    values = [None, 1.0, None, None, 4.0, None, None, None, None, 8.0, None]
    df = spark.createDataFrame([("a", t, v) for t, v in enumerate(values)], "k string, t long, v double")
    out = {r["t"]: (r["v"], r["v__imputed"]) for r in islands.impute(df, ["k"], "t", "v", 3).collect()}
    assert out[2] == (2.0, True) and out[3] == (3.0, True)
    assert out[0] == (None, False) and out[10] == (None, False) and out[6] == (None, False)
    forward = {r["t"]: r["v"] for r in islands.impute(df, ["k"], "t", "v", 3, forward=True).collect()}
    assert forward[3] == 1.0 and forward[10] == 8.0 and forward[6] is None


def test_segments_join_absent_rows_inside(spark):
    present = [0, 1, 3, 9, 10]
    df = spark.createDataFrame([("a", t, 1.0 if t in present else None) for t in range(12)], "k string, t long, v double")
    out = dict(rows(islands.segments(df, ["k"], "t", F.col("v").isNotNull(), 4), "t", "segment_id"))
    assert [out[t] for t in range(12)] == [0, 0, 0, 0, -1, -1, -1, -1, -1, 1, 1, -1]


def test_horizon_is_half_open_and_unknown_without_cover(spark):
    steps = spark.createDataFrame([("a", t * 600) for t in range(6)], "turbine string, step long")
    starts = spark.createDataFrame([("a", 1200)], "turbine string, start long")
    out = dict(rows(temporal.horizon_labels(steps, starts, ["turbine"], 2, "y"), "step", "y"))
    assert out == {0: True, 600: True, 1200: False, 1800: False, 2400: None, 3000: None}


def test_asof_and_existence(spark):
    left = spark.createDataFrame([("a", 5), ("a", 10), ("b", 1)], "k string, t long")
    right = spark.createDataFrame([("a", 5), ("a", 9), ("a", 11)], "k string, s long")
    assert rows(temporal.asof_backward(left, right, ["k"], "t", "s", "x"), "k", "t", "x")[:2] == [("a", 5, 5), ("a", 10, 9)]
    assert rows(temporal.asof_forward(left, right, ["k"], "t", "s", "x", 3).where("k = 'a'"), "t", "x")[1] == (10, 11)
    assert rows(temporal.exists_ahead(left, right, ["k"], "t", "s", 3, "x"), "k", "t", "x") == [("a", 5, False), ("a", 10, True), ("b", 1, False)]
    assert rows(temporal.exists_behind(left, right, ["k"], "t", "s", 1, "x"), "k", "t", "x") == [("a", 5, True), ("a", 10, False), ("b", 1, False)]


def test_overlap_join_counts_a_pair_once(spark):
    a = spark.createDataFrame([("k", 0, 100), ("k", 200, 210)], "k string, start long, end long")
    b = spark.createDataFrame([("k", 5, 95), ("k", 100, 200)], "k string, start long, end long")
    assert rows(temporal.overlap_join(a, b, ["k"], 10), "start", "start2") == [(0, 5)]


def test_stop_events_name_causes_with_ties_to_the_earliest(spark):
    stops = spark.createDataFrame([("t", 0, 600, "b"), ("t", 0, 600, "a"), ("t", 600, 1500, "b"), ("t", 9000, 9100, "a")], "turbine string, start long, end long, cause string")
    events = telemetry.select_events(telemetry.stop_steps(stops, ["a", "b"]), ["a", "b"], 600).collect()
    assert [(e["start"], e["end"], e["seconds"], e["first_cause"], e["dominant"]) for e in events] == [(0, 1800, 1500, "a", "b")]


def test_nan_is_missing_and_floors_keep_nulls(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,), (99.0,)], "v double").withColumn("v", S.null_nan(F.col("v")))
    out = [r["v"] for r in telemetry.apply_floors(telemetry.apply_bounds(df, {"v": (0.0, 50.0)}), {"v": 2.0}).collect()]
    assert out == [None, 2.0, None, None]


def test_split_rules_in_order(spark):
    df = spark.createDataFrame([(5, "s", "x"), (15, "s", "x"), (25, "h", "x"), (5, "h", "e")], "t long, site string, source string")
    out = df.select(splits.assign_split(F.col("t"), F.col("site"), F.col("source"), 10, 20, ["h"], ["e"]).alias("y")).collect()
    assert [r["y"] for r in out] == ["train", "val", "holdout", "evaluation"]


def test_intervals(spark):
    df = spark.createDataFrame([(0, 0), (3, 10)], "k long, n long")
    low, high = S.wilson(F.col("k"), F.col("n"))
    out = df.select(low.alias("l"), high.alias("h")).collect()
    assert out[0]["l"] is None and math.isclose(out[1]["l"], 0.10779, abs_tol=1e-4) and math.isclose(out[1]["h"], 0.60322, abs_tol=1e-4)
