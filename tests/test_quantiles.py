"""Order statistics by refinement, and bins laid from single facts, against all values in one place."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import binning
from gridloom.operators import quantiles as Q


def frame(spark, groups):
    rows = [(g, None if v is None else float(v)) for g, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "group string, value double")


def values_of_all_sizes(seed=3):
    rng = np.random.default_rng(seed)
    bits = rng.integers(0, 2**63 - 1, 4000, dtype=np.int64)
    doubles = np.array([struct.unpack("<d", struct.pack("<q", int(b)))[0] for b in bits])
    doubles = doubles[np.isfinite(doubles)] * rng.choice([-1, 1], np.isfinite(doubles).sum())
    return {
        "any": np.concatenate([doubles, [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308]]),
        "near": 1.0 + rng.integers(0, 3000, 5000) * 2.0**-52,
        "same": np.full(3000, 7.25),
        "mixed": np.concatenate([rng.normal(0, 1, 3000), np.zeros(2500), [1e200, -1e200]]),
        "one": [3.0],
        None: [2.0, 1.0, 1.0],
    }


def test_ranks_are_found_exactly(spark):
    groups = values_of_all_sizes()
    counted = Q.count_values(frame(spark, groups | {"any": [*groups["any"], None, math.nan, math.inf, -math.inf]}))
    ranks = {g: sorted({0, 1, len(v) // 3, len(v) // 2, len(v) - 1, *range(0, len(v), max(1, len(v) // 40))}) for g, v in groups.items()}
    rows = [(g, r) for g, rs in ranks.items() for r in [*rs, len(groups[g]), -1, *rs[:2]]] + [("nobody", 0)]
    got = Q.order_statistics(counted, spark.createDataFrame(rows, "group string, rank long")).collect()
    want = {(g, r): float(np.sort(groups[g])[r]) for g, rs in ranks.items() for r in rs if r < len(groups[g])}
    assert {(r["group"], r["rank"]): r["value"] for r in got} == want
    assert len(got) == len(want)


def test_quantiles_interpolate_as_numpy_does(spark):
    groups = {g: v for g, v in values_of_all_sizes().items() if g != "any"}
    shares = [0.0, 0.013, 0.25, 0.5, 0.75, 0.995, 1.0]
    asked = spark.createDataFrame([(g, s) for g in [*groups, "nobody"] for s in shares], "group string, share double")
    got = {(r["group"], r["share"]): r["quantile"] for r in Q.quantiles(Q.count_values(frame(spark, groups)), asked).collect()}
    assert set(got) == {(g, s) for g in groups for s in shares}
    for (g, s), q in got.items():
        assert math.isclose(q, float(np.quantile(np.array(groups[g]), s)), rel_tol=1e-12, abs_tol=1e-12)


def test_no_values_no_ranks(spark):
    empty = spark.createDataFrame([], "group string, value double")
    assert Q.order_statistics(Q.count_values(empty), spark.createDataFrame([("a", 0)], "group string, rank long")).count() == 0
    assert binning.fit_bins(empty.withColumnRenamed("group", "channel"), binning.BinRule(8)).count() == 0


@pytest.mark.parametrize(
    "rule",
    [
        binning.BinRule(16), binning.BinRule(16, True), binning.BinRule(64, True, None, 4), binning.BinRule(64, True, 2, 8, 0.01, 0.002), binning.BinRule(32, False, None, 4, 0.05, 0.4),
    ],
)
def test_bins_from_facts_are_those_of_all_values(spark, rule):
    rng = np.random.default_rng(8)
    groups = {
        "tails": np.concatenate([rng.normal(60, 3, 3000), rng.normal(95, 12, 60)]),
        "masses": np.concatenate([np.zeros(900), np.full(500, 4.5), rng.uniform(0.1, 9, 2500), np.full(700, 9.0)]),
        "steps": rng.integers(0, 40, 3000) / 4,
        "two": [1.0, 2.0] * 50,
        "one": [5.0] * 10,
        "falling": rng.exponential(3, 2500),
    }
    df = frame(spark, groups).withColumnRenamed("group", "channel")
    got = {r["channel"]: r.asDict() for r in binning.fit_bins(df, rule, held=0).collect()}
    direct = {r["channel"]: r.asDict() for r in binning.fit_bins(df, rule).collect()}
    assert got == direct and set(got) == set(groups)
    for g, v in groups.items():
        x, n = np.unique(np.asarray(v, float), return_counts=True)
        want = binning.lay_bins(binning.Counted(x, n), rule)
        assert np.allclose(got[g]["edges"], want["edges"], rtol=0, atol=0) and got[g]["masses"] == want["masses"] and got[g]["reps"] == want["reps"]


def test_slots_count_rows_between_cuts(spark):
    counted = Q.count_values(frame(spark, {"a": [1, 2, 2, 3, 5], "b": [4], "c": [1]}))
    cuts = spark.createDataFrame([("a", [2.0, 4.0]), ("b", [])], "group string, cuts array<double>")
    got = {(r["group"], r["slot"]): (r["n"], r["least"], r["most"]) for r in Q.slots(counted, cuts).collect()}
    assert got == {("a", 0): (1, 1, 1), ("a", 1): (3, 2, 3), ("a", 2): (1, 5, 5), ("b", 0): (1, 4, 4), ("c", 0): (1, 1, 1)}
    assert Q.slots(counted, cuts).select(F.sum("n")).first()[0] == 7
