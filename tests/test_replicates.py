"""Replicates of all statistics against rows that are really drawn."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import metrics, replicates

BINS, TAU, KAPPA, MARGIN = 4, 0.5, 0.3, 0.1


def rows_of(seed, n=160, blocks=7):
    rng = random.Random(seed)
    return [(k % blocks, rng.choice([0.1, 0.5, round(rng.random(), 2)]), round(rng.random(), 1), int(rng.random() < 0.3)) for k in range(n)]


def tied_mean(groups, weight):
    """Sum over groups (in order) of errors times the mean weight of the group's places."""
    at, out = 0, 0.0
    for _, n, k in groups:
        out += k / n * sum(weight(i) for i in range(at, at + n))
        at += n
    return out


def grouped(rows, value, flag):
    found = {}
    for r in rows:
        n, k = found.get(value(r), (0, 0))
        found[value(r)] = (n + 1, k + flag(r))
    return [(v, *found[v]) for v in sorted(found)]


def plain(rows):
    names = ("base_rate", "mean_p", "ece", "auprc", "error_rate", "coverage", "risk", "aurc", "margin_coverage", "margin_risk", "margin_aurc")
    n, pos = len(rows), sum(r[3] for r in rows)
    if not pos:
        return dict.fromkeys(names)
    error = lambda r: int((r[1] >= TAU) != bool(r[3]))
    share = lambda some: (len(some) / n, sum(map(error, some)) / len(some) if some else None)
    harmonics = [0.0]
    for i in range(1, n + 1):
        harmonics.append(harmonics[-1] + 1 / i)
    area = lambda value: tied_mean(grouped(rows, value, error), lambda i: (harmonics[n] - harmonics[i]) / n)
    spread = [(v, k / c) for v, c, k in grouped(rows, lambda r: r[1], lambda r: r[3]) for _ in range(c)]
    sizes = [n // BINS + (j < n % BINS) for j in range(BINS)]
    ece, at = 0.0, 0
    for size in sizes:
        part = spread[at : at + size]
        ece += abs(sum(v - y for v, y in part))
        at += size
    above, hits, ap = 0, 0, 0.0
    for _, c, k in reversed(grouped(rows, lambda r: r[1], lambda r: r[3])):
        above, hits = above + c, hits + k
        ap += k * hits / above
    c, s = share([r for r in rows if r[2] <= KAPPA]), share([r for r in rows if abs(r[1] - TAU) >= MARGIN])
    return dict(zip(names, (pos / n, sum(r[1] for r in rows) / n, ece / n, ap / pos, sum(map(error, rows)) / n, *c, area(lambda r: r[2]), *s, area(lambda r: -abs(r[1] - TAU))), strict=True))


@pytest.mark.parametrize("leaf", [5, 1 << 16])
def test_replicates_match_drawn_rows(spark, leaf):
    rows = rows_of(3)
    df = spark.createDataFrame([*rows, (0, None, 0.1, 1), (1, 0.5, 0.2, None)], "block long, p double, u double, label int")
    got = {(r["replicate"], r["statistic"]): r["value"] for r in replicates.replicate_statistics(df, 6, 9, BINS, TAU, KAPPA, MARGIN, leaf=leaf).collect()}
    times = {(r["replicate"], r["block"]): r["times"] for r in metrics.block_draws(df.select("block").distinct(), 6, 9).collect()}
    assert len(got) == 66
    for k in range(6):
        drawn = [r for r in rows for _ in range(times.get((k, r[0]), 0))]
        for name, value in plain(drawn).items():
            assert math.isclose(got[k, name], value, rel_tol=1e-9, abs_tol=1e-12), (k, name)


def test_replicates_without_positives_are_null_and_counted(spark):
    df = spark.createDataFrame([(b, 0.2, 0.9, int(b == 0)) for b in range(4)], "block long, p double, u double, label int")
    told = replicates.replicate_statistics(df, 40, 1, BINS, TAU, KAPPA, MARGIN)
    times = {r["replicate"] for r in metrics.block_draws(df.select("block").distinct(), 40, 1).where("block = 0").collect()}
    found = {r["replicate"] for r in told.where("statistic = 'auprc' and value is not null").collect()}
    assert found == times and 0 < len(times) < 40
    assert told.where("statistic = 'risk' and value is not null").count() == 0  # nothing is covered
    by = {r["statistic"]: r for r in replicates.intervals(told).collect()}
    assert by["auprc"]["discarded"] == 40 - len(times) and not by["auprc"]["trusted"] and by["auprc"]["replicates"] == 40
    zero = replicates.paired_differences(told, told)
    assert zero.where("value <> 0").count() == 0 and zero.count() == told.count()
    with pytest.raises(Exception, match="unpaired"):
        replicates.paired_differences(told, told.where("replicate <> 3")).collect()
    assert replicates.replicate_statistics(df.where("false"), 3, 1, BINS, TAU, KAPPA, MARGIN).where("value is not null").count() == 0


def test_sums_of_harmonic_numbers_near_and_far(spark):
    rows = [(a, n) for a in (0, 1, 10, 999, 1001, 40_000) for n in (1, 2, 300)]
    got = spark.createDataFrame(rows, "a long, n long").select("a", "n", replicates.harmonic_sum(F.col("a"), F.col("n")).alias("s")).collect()
    h = [0.0]
    for i in range(1, 41_000):
        h.append(h[-1] + 1 / i)
    for r in got:
        assert math.isclose(r["s"], sum(h[r["a"] : r["a"] + r["n"]]), rel_tol=1e-10, abs_tol=1e-10)
