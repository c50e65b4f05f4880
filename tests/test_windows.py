"""Flags, masks, persistence, checked joins, samples and write-once tables against plain versions."""

import hashlib
import math
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from gridloom.operators import evaluated as E
from gridloom.operators import samplers
from gridloom.operators import windows as N
from gridloom.sources import sinks


@pytest.mark.parametrize("leaf", [1 << 16, 7, 1])
def test_marks_before_places_are_counted(spark, leaf):
    rng = random.Random(leaf)
    points = [(rng.choice("ab"), rng.choice([rng.randrange(-20, 60), None]), k) for k in range(80)]
    marks = [(rng.choice("ac"), rng.choice([rng.randrange(-20, 60), None])) for _ in range(60)]
    p, m = spark.createDataFrame(points, "k string, x long, id int"), spark.createDataFrame(marks, "k string, y long")
    for inclusive in (False, True):
        got = {r["id"]: r["n"] for r in N.count_before(p, m, ["k"], "x", "y", "n", inclusive, leaf).collect()}
        want = {i: 0 if x is None else sum(k == q and y is not None and (y < x or inclusive and y == x) for q, y in marks) for k, x, i in points}
        assert got == want


def streams(seed):
    """Per key a stream of steps with 3 tokens and messages behind some: step offsets, messages (opens, closes, step, flag), size."""
    rng = random.Random(seed)
    out = {}
    for key in ("s", "t"):
        at, offsets, messages = 0, [], []
        for step in range(60):
            offsets.append(at)
            at += 3
            for _ in range(rng.choice([0, 0, 1, 2])):
                n = rng.randint(2, 9)
                messages.append((at, at + n, step, rng.random() < 0.15))
                at += n
        out[key] = (offsets, messages, at)
    return out


def test_flags_and_masks_of_windows_cut_anywhere(spark):
    held = streams(3)
    rng = random.Random(1)
    windows = []
    for key, (offsets, _, size) in held.items():
        for end in range(0, 60, 2):
            last = offsets[end + 1] if end < 59 else size
            length = rng.randint(0, 30)
            windows.append((key, end, last - length if last - length >= 0 else 0, min(length, last)))
    w = spark.createDataFrame(windows, "k string, end_step long, first long, length long")
    messages = spark.createDataFrame([(k, *m) for k, (_, ms, _) in held.items() for m in ms], "k string, opens long, closes long, step long, flag boolean")
    got = {(r["k"], r["end_step"]): (r["capped"], r["uncapped"]) for r in N.flagged_windows(w, messages, ["k"], 5, leaf=11).collect()}
    for k, end, first, length in windows:
        flagged = [m for m in held[k][1] if m[3]]
        capped = length > 0 and any(o < first + length and c > first for o, c, *_ in flagged)
        assert got[k, end] == (capped, any(end - 5 < s <= end for *_, s, _ in flagged)), (k, end)
    steps = spark.createDataFrame([(k, o) for k, (offsets, *_) in held.items() for o in offsets], "k string, offset long")
    for size in (4096, 5):
        places = {(r["k"], r["end_step"]): r["places"] for r in N.mask_places(w, steps, ["k"], [1, 2], 3, size).collect()}
        for k, end, first, length in windows:
            assert places[k, end] == sorted(o + c - first for o in held[k][0] for c in (1, 2) if 0 <= o + c - first < length)
    one = spark.createDataFrame([([5, 1, 700], [0]), ([5, 1, 700], []), ([5, 1, 700], [2]), ([5, 1, 700], [1])], "t array<long>, p array<long>")
    masked = one.where("coalesce(get(p, 0), 0) = 0").select(N.mask_window(F.col("t"), F.col("p"), 9, 600, [1]).alias("m"))
    assert sorted(r["m"] for r in masked.collect()) == [[5, 1, 700], [9, 1, 700]]
    with pytest.raises(Exception, match="no value token: 700"):
        one.where("get(p, 0) = 2").select(N.mask_window(F.col("t"), F.col("p"), 9, 600, [1])).collect()
    with pytest.raises(Exception, match="no value token: 1"):
        one.where("get(p, 0) = 1").select(N.mask_window(F.col("t"), F.col("p"), 9, 600, [1])).collect()


def test_persistence_takes_one_order_for_all_features(spark):
    rng = random.Random(8)
    rows = [("ab"[i % 2], t) for i, t in enumerate(range(0, 90_000, 1800))]
    events = [(rng.choice("abc"), rng.randrange(90_000)) for _ in range(9)] + [("a", 3600), ("a", None)]
    stops = [(rng.choice("ab"), rng.randrange(90_000)) for _ in range(5)]
    frame = lambda x: spark.createDataFrame(x, "k string, t long")
    out = N.persistence(frame(rows), frame(events), frame(stops), ["k"], "t", 7200, 12.0, [3600])
    for r in out.collect():
        seen = [t for k, t in events if k == r["k"] and t is not None and t <= r["t"]]
        halted = [t for k, t in stops if k == r["k"] and t <= r["t"]]
        assert r["p1"] == float(any(r["t"] - 7200 < t for t in seen)) and r["p3"] == float(any(r["t"] - 7200 < t for t in halted))
        assert r["within_3600"] == any(r["t"] - 3600 < t for t in seen)
        assert math.isclose(r["p2"], -min(12.0, (r["t"] - max(seen)) / 3600 if seen else 12.0))
    assert out.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    status = spark.createDataFrame([("a", 1, "7", "Stop"), ("a", 600, "7", "Stop"), ("a", 601, "8", "Stop"), ("a", 5, "7", "Run"), ("a", None, "7", "Stop")], "turbine string, start long, code string, status string")
    assert sorted(r["at"] for r in N.attached_stops(status, [7], "Stop", 600).collect()) == [600, 600]


def test_joins_refuse_missing_doubled_and_differing_rows(spark):
    scores = spark.createDataFrame([("s", 1, 0.5, True), ("s", 2, 0.6, False), (None, 3, 0.1, True)], "shard string, end_step int, p double, y boolean")
    index = spark.createDataFrame([("s", 1, True, 7, True), ("s", 2, False, None, None), (None, 3, True, 9, False)], "shard string, end_step int, y boolean, turbine int, z boolean")
    keys, seen = ["shard", "end_step"], Observation()
    rows = {r["end_step"]: r for r in E.evaluated_rows(scores, index, keys, {"y": "y"}, seen).collect()}
    assert rows[1]["turbine"] == 7 and rows[3]["z"] is False and len(rows) == 3 and seen.get == {"rows": 3, "unlabelled": 1}
    for bad_scores, bad_index, what in (
        (scores.where("end_step < 3"), index, "not scored: shard=null, end_step=3"),
        (scores, index.where("end_step > 1"), "not in the index: shard=s, end_step=1"),
        (scores.union(scores.where("end_step = 2")), index, "repeated in the scores: shard=s, end_step=2"),
        (scores, index.union(index.where("end_step = 1")), "repeated in the index: shard=s, end_step=1"),
        (scores.withColumn("y", F.lit(True)), index, "y differs: shard=s, end_step=2"),
    ):
        with pytest.raises(Exception, match=what):
            E.evaluated_rows(bad_scores, bad_index, keys, {"y": "y"}).collect()
    told = E.relabelled(scores, index.withColumn("z_known", F.col("z").isNotNull()), keys, "y", "z")
    assert {r["end_step"]: (r["z"], r["z_known"]) for r in told.collect()} == {1: (True, True), 2: (False, False), 3: (False, True)}


def test_samples_per_group_don_t_depend_on_partitioning(spark):
    rows = [("g" if k % 3 else "h", k, float(k % 5)) for k in range(400)] + [("one", 1000, 1.0)]
    df = spark.createDataFrame(rows, "g string, k long, w double")
    picked = lambda d, **more: sorted((r["g"], r["k"]) for r in samplers.bottom_k(d, ["g"], "k", 6, 4, **more).collect())
    order = lambda k: hashlib.md5(f"4:{k}".encode()).hexdigest()
    want = sorted(("g" if k % 3 else "h", k) for h in (True, False) for k in sorted((k for k in range(400) if (k % 3 == 0) == h), key=order)[:6]) + [("one", 1000)]
    assert picked(df.repartition(7)) == picked(df.coalesce(1)) == want
    plan = samplers.bottom_k(df, ["g"], "k", 6, 4)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    heavy = picked(df.withColumn("w", F.when(F.col("k") % 100 < 3, 1000.0).otherwise(F.col("w") / 1000)), weight="w")
    assert sum(k % 100 < 3 for _, k in heavy) >= 11 and all(k % 100 < 3 or k % 5 for _, k in heavy if k < 1000)


def test_tables_are_committed_once(spark, tmp_path):
    path = f"file://{tmp_path}/points"
    df = spark.createDataFrame([(1, 0.5), (2, None)], "k int, tau double")
    assert sinks.write_once(df, path) is True
    assert sinks.write_once(df.orderBy(F.desc("k")), path) is False
    with pytest.raises(ValueError, match="other rows"):
        sinks.write_once(df.withColumn("tau", F.lit(0.25)), path)
    assert sorted(map(tuple, sinks.read_once(spark, path).collect())) == [(1, 0.5), (2, None)]
    assert len([p for p in (tmp_path / "points").iterdir() if p.name.startswith("rows-")]) == 1
    with pytest.raises(Exception):
        sinks.read_once(spark, f"file://{tmp_path}/nowhere")

    def attempt(k):
        try:
            return sinks.write_once(df.withColumn("tau", F.lit(k / 8)), f"file://{tmp_path}/race")
        except ValueError:
            return None

    with ThreadPoolExecutor(4) as pool:
        results = list(pool.map(attempt, range(4)))
    assert sorted(map(str, results)) == ["None", "None", "None", "True"]
    assert sinks.read_once(spark, f"file://{tmp_path}/race").first()["tau"] == results.index(True) / 8
