"""The whole set of statistics of scored rows, with ranks by leaves of the score, random references and paired effects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics
from .shards import rank_by_hash

GAMMA = 0.5772156649015329


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n; 0 for 0. Exact up to 16, by Euler's expansion beyond (to 1e-12)."""
    table, total = [0.0], 0.0
    for k in range(1, 17):
        total += 1.0 / k
        table.append(total)
    x = n.cast("double")
    far = F.log(x) + GAMMA + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    return F.when(n <= 16, F.array(*map(F.lit, table))[F.least(n, F.lit(16)).cast("int")]).otherwise(far)


def admission_weight(rank: Column, n: Column) -> Column:
    """Weight of the error of the row admitted rank-th (from 0) in the area under the risk-coverage curve of n rows."""
    return (harmonic(n) - harmonic(rank)) / n


def random_aurc(df: DataFrame, by: Sequence[str], key: str, seeds: Sequence[int]) -> DataFrame:
    """by, aurc_random: the area under random admission, the mean of one order per seed. No order is made in one task."""
    rows = df.select(*by, key, F.col("error").cast("double").alias("error"), F.explode(F.array(*map(F.lit, seeds))).alias("_seed"))
    ranked = rank_by_hash(rows, [*by, "_seed"], F.concat_ws(":", F.col("_seed").cast("string"), F.col(key).cast("string")), "_rank")
    sizes = rows.groupBy(*by, "_seed").agg(F.count("*").alias("_n"))
    per = ranked.join(sizes, [*by, "_seed"]).groupBy(*by, "_seed").agg(F.sum(F.col("error") * admission_weight(F.col("_rank"), F.col("_n"))).alias("a"))
    return per.groupBy(*by).agg(F.avg("a").alias("aurc_random"))


def statistics(df: DataFrame, by: Sequence[str], key: str, bins: int, tau: float, kappa: float, margin: float, seeds: Sequence[int] = ()) -> DataFrame:
    """by and base_rate, mean_p, ece, auprc, coverage, risk, aurc, margin_coverage, margin_risk, margin_aurc, aurc_random of rows (key, p, u, label).

    A row is covered if u <= kappa, or by margin if |p - tau| >= margin.
    """
    p, y = F.col("p"), F.col("label").cast("int")
    rows = df.withColumn("score", p).withColumn("error", (p >= tau).cast("int") != y).withColumn("_m", F.abs(p - tau))
    by = list(by)
    simple = rows.groupBy(*by).agg(F.avg(y.cast("double")).alias("base_rate"), F.avg("p").alias("mean_p"))
    ece = metrics.expected_calibration_error(metrics.equal_mass_table(rows, bins, by, key), by)
    ap = metrics.average_precision(rows, by).select(*by, F.col("ap").alias("auprc"))
    out = simple.join(ece, by).join(ap, by)
    for prefix, confidence, cut in (("", -F.col("u"), -kappa), ("margin_", F.col("_m"), margin)):
        some = rows.withColumn("confidence", confidence)
        at = metrics.coverage_and_risk(some, cut, by).withColumnsRenamed({"coverage": f"{prefix}coverage", "risk": f"{prefix}risk"})
        area = metrics.aurc(some, by, key).select(*by, F.col("aurc").alias(f"{prefix}aurc"))
        out = out.join(at, by).join(area, by)
    return out.join(random_aurc(rows, by, key, seeds), by) if seeds else out


def paired_effect(df: DataFrame, by: Sequence[str], key: str, a: str, b: str, replicates: int, seed: int) -> DataFrame:
    """by, effect, low, high: the mean of a - b over strings, with a bootstrap interval of resampled strings.

    A string is drawn as often as a Poisson variable of its hash says, so draws
    need no numbering of strings.
    """
    d = (F.col(a) - F.col(b)).cast("double")
    reps = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))
    rows = df.select(*by, key, d.alias("_d"), reps.alias("_r"))
    place = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_r").cast("string"), F.col(key).cast("string")).cast("binary")), 1, 12), 16, 10).cast("long"), F.lit(1 << 40)) / float(1 << 40)
    times, total, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(12):
        total += term
        times = times + F.when(place >= total, 1).otherwise(0)
        term /= k + 1
    per = rows.withColumn("_t", times).groupBy(*by, "_r").agg(F.try_divide(F.sum(F.col("_d") * F.col("_t")), F.sum("_t")).alias("m"))
    tails = per.groupBy(*by).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    mean = df.groupBy(*by).agg(F.avg(d).alias("effect"))
    return mean.join(tails, list(by)) if by else mean.crossJoin(tails)


def ap_by_thresholds(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, ap: average precision a second way: each positive's precision among the rows that score at least as much."""
    counts = df.groupBy(*by, "score").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("k"))
    at = counts.alias("t").select(*by, F.col("score").alias("_t"), F.col("k").alias("_k"))
    above = at.join(counts, list(by)).where(F.col("score") >= F.col("_t")) if by else at.crossJoin(counts).where(F.col("score") >= F.col("_t"))
    per = above.groupBy(*by, "_t", "_k").agg((F.sum("k") / F.sum("n")).alias("precision"))
    return per.groupBy(*by).agg(F.try_divide(F.sum(F.col("_k") * F.col("precision")), F.sum("_k")).alias("ap"))


def mean_predicted(df: DataFrame, by: Sequence[str], logit: str, offset: float) -> DataFrame:
    """by, mean_p: the mean probability of logits moved by an offset."""
    from ..functions.scalars import sigmoid

    return df.groupBy(*by).agg(F.avg(sigmoid(F.col(logit) + offset)).alias("mean_p"))
