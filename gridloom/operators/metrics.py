"""Statistics over scored rows: ranking, calibration, risk-coverage, resampling.

Thresholds are made from counts per distinct score; orders of rows, with their
ties, from leaves of at most so many rows (ranks). A key is used wherever one is given.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import sigmoid, softplus
from . import ranks


def _down(by: Sequence[str]):
    return W.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)


def score_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, score, n, pos: rows and positives of each distinct score."""
    return df.groupBy(*by, "score").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("pos"))


def average_precision(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, windows, positives, ap, base_rate, lift; a threshold admits all rows of a score; null ap without positives."""
    w = _down(by)
    counts = score_counts(df, by).withColumn("_n", F.sum("n").over(w)).withColumn("_p", F.sum("pos").over(w))
    out = counts.groupBy(*by).agg(
        F.sum("n").alias("windows"), F.sum("pos").alias("positives"), F.sum(F.col("pos") * F.col("_p") / F.col("_n")).alias("_s")
    )
    ap = F.when(F.col("positives") > 0, F.col("_s") / F.col("positives"))
    base = F.col("positives") / F.col("windows")
    return out.withColumn("ap", ap).withColumn("base_rate", base).withColumn("lift", ap / base).drop("_s")


def cross_entropy(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, loss: mean softplus(x) - y x of logits x."""
    return df.groupBy(*by).agg(F.avg(softplus(F.col("logit")) - F.col("label").cast("double") * F.col("logit")).alias("loss"))


def calibration_table(df: DataFrame, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """by, bin, n, mean_p, mean_y over equal-width bins of p."""
    place = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("label").cast("double")).alias("mean_y"))


def expected_calibration_error(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return table.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")).alias("ece"))


def equal_mass_table(df: DataFrame, bins: int, by: Sequence[str], tie: str, leaf: int = ranks.LEAF) -> DataFrame:
    """The same table over bins of equal counts, larger bins first, ties in the order of tie."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    placed = ranks.running(df.select(*by, "p", tie, "label"), by, "p", tie, leaf=leaf)
    placed = placed.join(sizes, list(by)) if by else placed.crossJoin(F.broadcast(sizes))  # one row
    placed = placed.withColumn("bin", ranks.part_of(F.col("rank"), F.col("_n"), bins))
    return placed.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("label").cast("double")).alias("mean_y"))


def risk_coverage(df: DataFrame, by: Sequence[str], tie: str, leaf: int = ranks.LEAF) -> DataFrame:
    """df with rank and risk: the error rate of the rows admitted so far, most confident first."""
    placed = ranks.running(df, by, "confidence", tie, {"_errors": F.col("error").cast("long")}, descending=True, leaf=leaf)
    return placed.withColumn("risk", F.col("_errors") / F.col("rank")).drop("_errors")


def aurc(df: DataFrame, by: Sequence[str], tie: str) -> DataFrame:
    return risk_coverage(df, by, tie).groupBy(*by).agg(F.avg("risk").alias("aurc"), F.avg(F.col("error").cast("double")).alias("error_rate"))


def harmonic_weights(n: int) -> np.ndarray:
    """Weight of the i-th admitted row's error in the area under the curve."""
    return np.cumsum((1.0 / np.arange(1, n + 1))[::-1])[::-1] / n


def best_f1(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, tau, f1: the score threshold with the best F1, the smallest of ties."""
    w = _down(by)
    counts = score_counts(df, by).withColumn("_n", F.sum("n").over(w)).withColumn("_p", F.sum("pos").over(w))
    total = F.sum("pos").over(W.partitionBy(*by))
    # 2 p / (n + total) as a fraction: compared by value rounded where exact ties are possible
    f1 = F.round(2 * F.col("_p") / (F.col("_n") + F.col("_t")), 12)
    ranked = counts.withColumn("_t", total).withColumn("f1", f1)
    return ranked.groupBy(*by).agg(F.max(F.struct("f1", (-F.col("score")).alias("s"))).alias("b")).select(*by, (-F.col("b.s")).alias("tau"), F.col("b.f1").alias("f1"))


def lower_quantile(df: DataFrame, value: str, q: float, by: Sequence[str] = ()) -> DataFrame:
    """by, cut: the value at place floor((n - 1) q) in rising order."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    counts = counts.withColumn("_c", upto).withColumn("_n", F.sum("n").over(W.partitionBy(*by)))
    return counts.where(F.col("_c") > F.floor((F.col("_n") - 1) * q)).groupBy(*by).agg(F.min(value).alias("cut"))


def coverage_and_risk(df: DataFrame, cut: float, by: Sequence[str] = ()) -> DataFrame:
    inside = F.col("confidence") >= cut
    return df.groupBy(*by).agg(F.avg(inside.cast("double")).alias("coverage"), F.avg(F.when(inside, F.col("error").cast("double"))).alias("risk"))


def ensemble(scores: DataFrame, key: str) -> DataFrame:
    """key, label, p (mean probability), disagreement (population deviation of logits) over at least two members."""
    out = scores.groupBy(key).agg(
        F.max("label").alias("label"), F.avg(sigmoid(F.col("logit"))).alias("p"), F.stddev_pop("logit").alias("disagreement"), F.count("*").alias("members")
    )
    return out.where("members >= 2")


def block_draws(blocks: DataFrame, replicates: int, seed: int) -> DataFrame:
    """replicate, block, times: as many draws as blocks, with replacement, by hash.

    blocks has dense ids (block, from 0). Draws are rows of hashes, so nothing
    depends on partitioning and an engine with the same hash agrees.
    """
    spark = blocks.sparkSession
    n = blocks.count()
    draws = spark.range(replicates * n).select(F.expr(f"id div {max(n, 1)}").alias("replicate"), F.expr(f"id % {max(n, 1)}").alias("draw"))
    text = F.concat_ws(":", F.lit(str(seed)), "replicate", "draw")
    place = F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long"), F.lit(max(n, 1)))
    return draws.select("replicate", place.alias("block")).groupBy("replicate", "block").agg(F.count("*").alias("times"))


def bootstrap_ap(df: DataFrame, replicates: int, seed: int) -> DataFrame:
    """replicate, ap, base_rate over rows (block, score, label), whole blocks drawn."""
    per = df.groupBy("block", "score").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("pos"))
    drawn = per.join(block_draws(df.select("block").distinct(), replicates, seed), "block")
    counts = drawn.groupBy("replicate", "score").agg(F.sum(F.col("n") * F.col("times")).alias("n"), F.sum(F.col("pos") * F.col("times")).alias("pos"))
    w = _down(["replicate"])
    counts = counts.withColumn("_n", F.sum("n").over(w)).withColumn("_p", F.sum("pos").over(w))
    out = counts.groupBy("replicate").agg(F.sum("n").alias("_n"), F.sum("pos").alias("_p"), F.sum(F.col("pos") * F.col("_p") / F.col("_n")).alias("_s"))
    return out.select("replicate", F.when(F.col("_p") > 0, F.col("_s") / F.col("_p")).alias("ap"), (F.col("_p") / F.col("_n")).alias("base_rate"))


def percentile_interval(replicates: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """low, high, mean, discarded over non-null replicates."""
    tail = (1 - level) / 2
    return replicates.agg(
        F.percentile(value, F.lit(tail)).alias("low"), F.percentile(value, F.lit(1 - tail)).alias("high"), F.avg(value).alias("mean"),
        (F.count("*") - F.count(value)).alias("discarded"),
    )


def balanced_shift(df: DataFrame, logit: str, target: float, tolerance: float = 1e-6) -> float:
    """Shift c with mean(sigmoid(logit + c)) = target, by bisection over a histogram of 2**16 logits made once."""
    width = 1 / 1024
    table = df.groupBy(F.round(F.col(logit) / width).alias("k")).agg(F.count("*").alias("n"), F.avg(logit).alias("x")).toPandas()
    x, n = table["x"].to_numpy(), table["n"].to_numpy()
    low, high = -60.0, 60.0
    while high - low > tolerance:
        mid = (low + high) / 2
        if (n / (1 + np.exp(-np.clip(x + mid, -500, 500)))).sum() / n.sum() < target:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def fit_platt(df: DataFrame, logit: str = "logit", label: str = "label", steps: int = 25) -> tuple[float, float]:
    """Slope and intercept of a logistic fit; each Newton step is one distributed aggregate of five sums."""
    a, b = 1.0, 0.0
    data = df.select(F.col(logit).alias("x"), F.col(label).cast("double").alias("y")).cache()
    for _ in range(steps):
        p = sigmoid(F.col("x") * a + b)
        w = p * (1 - p)
        row = data.agg(
            F.sum((p - F.col("y")) * F.col("x")), F.sum(p - F.col("y")), F.sum(w * F.col("x") * F.col("x")), F.sum(w * F.col("x")), F.sum(w)
        ).first()
        g = np.array([row[0], row[1]], float)
        h = np.array([[row[2], row[3]], [row[3], row[4]]], float) + 1e-12 * np.eye(2)
        move = np.linalg.solve(h, g)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-10:
            break
    data.unpersist()
    return float(a), float(b)


def interval_position(low: Column, high: Column, line: float, trusted: Column) -> Column:
    return F.when((low > line) & trusted, "clears").when(high < line, "below").otherwise("contains")


def mantel_haenszel(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pooled rate ratio over rows (a, at, b, bt) of strata; strata without both exposures are left out."""
    ok = df.where("at > 0 and bt > 0")
    total = F.col("at") + F.col("bt")
    return ok.groupBy(*by).agg(F.count("*").alias("strata"), (F.sum(F.col("a") * F.col("bt") / total) / F.sum(F.col("b") * F.col("at") / total)).alias("ratio"))
