"""All statistics of scored rows on every bootstrap replicate, from block contributions.

Rows are summed once per block, and once per block and value for the ranked
statistics. Joined to how often a replicate draws each block, these sums give
the replicate's, so rows are not repeated per replicate. Orders run over
different values, in leaves (ranks). Rows of one value are a group without an
order inside: areas and bins take the mean over its orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks
from .metrics import block_draws
from .statistics import harmonic
from .tables import written


def harmonic_sum(a: Column, n: Column) -> Column:
    """H(a) + ... + H(a + n - 1), where H are harmonic numbers; also exact in relation to n where a is large."""
    b = a + n
    far = F.log1p(n / F.greatest(a, F.lit(1))) + 1 / (2 * b) - 1 / (2 * a) - 1 / (12 * b * b) + 1 / (12 * a * a)
    gap = F.when(a > 1000, far).otherwise(harmonic(b) - harmonic(a))
    return n * harmonic(b) + a * gap - n


def tied_area(n: Column, before: Column, errors: Column, total: Column) -> Column:
    """What n rows of one value, admitted behind before others, add to the area under the risk-coverage curve of total rows."""
    return errors / n * (n * harmonic(total) - harmonic_sum(before, n)) / total


def replicate_statistics(df: DataFrame, replicates: int, seed: int, bins: int, tau: float, kappa: float, margin: float, leaf: int = ranks.LEAF) -> DataFrame:
    """replicate, statistic, value of rows (block, p, u, label); block numbers are dense, from 0 on.

    Statistics are base_rate, mean_p, ece (over bins of equal counts), auprc,
    and for the alarm p >= tau: error_rate, which is the expected area under
    random admission, and coverage, risk, aurc of rows with u <= kappa, admitted
    by rising u, as well as margin_coverage, margin_risk, margin_aurc with
    |p - tau| >= margin, admitted by falling |p - tau|. A replicate that draws
    no positive row, or no row, has nulls throughout, and risk is null where
    nothing is covered. Rows with a null in p, u or label are left out.
    """
    rows = df.select("block", F.col("p").cast("double").alias("p"), F.col("u").cast("double").alias("u"), F.col("label").cast("int").alias("y")).dropna()
    p, u, y = F.col("p"), F.col("u"), F.col("y")
    e, m = ((p >= tau).cast("int") != y).cast("long"), F.abs(p - tau)
    one = F.lit(1).cast("long")
    covered, sure = (u <= kappa).cast("long"), (m >= margin).cast("long")
    sums = {"n": one, "pos": y.cast("long"), "p": p, "err": e, "c": covered, "ce": covered * e, "s": sure, "se": sure * e}
    per_block = rows.groupBy("block").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    draws = written(block_draws(df.select("block").distinct(), replicates, seed), "draws")
    every = df.sparkSession.range(replicates).select(F.col("id").alias("replicate"))
    drawn = per_block.join(draws, "block").groupBy("replicate").agg(*[F.sum(F.col(k) * F.col("times")).alias(k) for k in sums])
    totals = written(every.join(drawn, "replicate", "left"), "replicates")

    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value"), x.cast("long").alias("k")) for k, v, x in (("p", p, y), ("u", u, e), ("m", -m, e))])
    counts = rows.select("block", F.inline(kinds)).groupBy("kind", "block", "value").agg(F.count("*").alias("n"), F.sum("k").alias("k"))
    times = F.col("times")
    drawn = counts.join(draws, "block").groupBy("kind", "replicate", "value").agg(F.sum(F.col("n") * times).alias("n"), F.sum(F.col("k") * times).alias("k"))
    placed = ranks.running(drawn, ["kind", "replicate"], "value", "n", {"cn": F.col("n"), "ck": F.col("k")}, leaf=leaf)
    placed = placed.join(totals.select("replicate", F.col("n").alias("rows"), F.col("pos").alias("positives")), "replicate")
    n, k, before, total = F.col("n"), F.col("k"), F.col("cn") - F.col("n"), F.col("rows")
    precision = k * (F.col("positives") - F.col("ck") + k) / (total - before)
    parts = F.sequence(ranks.part_of(before + 1, total, bins), ranks.part_of(F.col("cn"), total, bins))
    size, more = F.floor(total / bins), total % bins
    start = lambda j: (j - 1) * size + F.least(j - 1, more)
    slices = F.transform(parts, lambda j: F.struct(j.alias("bin"), (F.least(F.col("cn"), start(j + 1)) - F.greatest(before, start(j))).alias("c")))
    binned = placed.where("kind = 'p'").select("replicate", "value", (k / n).alias("rate"), F.inline(slices))
    binned = binned.groupBy("replicate", "bin").agg(F.abs(F.sum(F.col("c") * F.col("value")) - F.sum(F.col("c") * F.col("rate"))).alias("gap"))
    ece = binned.groupBy("replicate").agg(F.sum("gap").alias("ece"))
    ranked = placed.groupBy("replicate").agg(
        F.sum(F.when(F.col("kind") == "p", precision)).alias("auprc"),
        *[F.sum(F.when(F.col("kind") == kind, tied_area(n, before, k, total))).alias(name) for kind, name in (("u", "aurc"), ("m", "margin_aurc"))],
    )
    known = totals.join(ece, "replicate", "left").join(ranked, "replicate", "left")
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    found = {
        "base_rate": ratio("pos", "n"), "mean_p": ratio("p", "n"), "ece": ratio("ece", "n"), "auprc": ratio("auprc", "pos"), "error_rate": ratio("err", "n"),
        "coverage": ratio("c", "n"), "risk": ratio("ce", "c"), "aurc": F.col("aurc"),
        "margin_coverage": ratio("s", "n"), "margin_risk": ratio("se", "s"), "margin_aurc": F.col("margin_aurc"),
    }
    pairs = F.array(*[F.struct(F.lit(name).alias("statistic"), F.when(F.col("pos") > 0, value).alias("value")) for name, value in found.items()])
    return known.select("replicate", F.inline(pairs))


def intervals(replicates: DataFrame, level: float = 0.95, most_discarded: float = 0.05) -> DataFrame:
    """statistic, low, high, mean, replicates, discarded, trusted: the central interval of each statistic over replicates that have it."""
    tail = (1 - level) / 2
    out = replicates.groupBy("statistic").agg(
        F.percentile("value", F.lit(tail)).alias("low"), F.percentile("value", F.lit(1 - tail)).alias("high"), F.avg("value").alias("mean"),
        F.count("*").alias("replicates"), (F.count("*") - F.count("value")).alias("discarded"),
    )
    return out.withColumn("trusted", F.col("discarded") <= most_discarded * F.col("replicates"))


def paired_differences(one: DataFrame, other: DataFrame) -> DataFrame:
    """replicate, statistic, value: one minus other, replicate by replicate; it is an error if one side lacks a replicate that the other has."""
    a, b = one.withColumnRenamed("value", "_a"), other.withColumnRenamed("value", "_b")
    both = a.withColumn("_in", F.lit(True)).join(b.withColumn("_too", F.lit(True)), ["replicate", "statistic"], "full")
    message = F.concat(F.lit("unpaired: replicate "), F.col("replicate").cast("string"), F.lit(", "), F.col("statistic"))
    value = F.when(F.col("_in").isNull() | F.col("_too").isNull(), F.raise_error(message).cast("double")).otherwise(F.col("_a") - F.col("_b"))
    return both.select("replicate", "statistic", value.alias("value"))
