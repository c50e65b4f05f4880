"""Seeded samples and batches by hash, and the schedule of mixed streams."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_order(seed: int, key: Column) -> Column:
    """A random order that depends on seed and key alone."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, the first in hash order; a bounded top-n, never a full sort."""
    return df.withColumn("_h", hash_order(seed, F.col(key))).orderBy("_h", key).limit(n).drop("_h")


def bottom_k(df: DataFrame, by: list[str], key: str, k: int, seed: int, weight: str | None = None) -> DataFrame:
    """k rows of each group of by (all of a smaller one), without replacement, whatever the partitioning.

    Rows stand by a keyed hash, or with weight by an exponential of it over the
    weight, so a row is drawn first with a chance in proportion; rows without a
    positive weight are never drawn. Tasks keep k rows a group before the
    shuffle, so a group is never gathered. Ties of the hash go by key.
    """
    h = hash_order(seed, F.col(key))
    order = h
    if weight is not None:
        df = df.where(F.col(weight) > 0)
        uniform = (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
        order = -F.log(uniform) / F.col(weight)
    rows = df.withColumn("_h", order)
    n = F.row_number().over(W.partitionBy(*by).orderBy("_h", key))
    return rows.withColumn("_n", n).where(F.col("_n") <= k).drop("_h", "_n")


def balanced_batches(df: DataFrame, key: str, label: str, positives: int, size: int, seed: int) -> DataFrame:
    """Adds batch: each holds exactly so many positives, and negatives up to size; rows that fill no whole batch go.

    Classes are numbered in hash order inside slices of the hash, so a class
    with most rows is not gathered in one task.
    """
    h = df.withColumn("_h", hash_order(seed, F.col(key))).withColumn("_s", F.substring("_h", 1, 2))
    slices = h.groupBy(label, "_s").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.partitionBy(label).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_c").over(W.partitionBy(label))
    slices = slices.withColumn("_before", before).withColumn("_total", total)
    n = F.row_number().over(W.partitionBy(label, "_s").orderBy("_h", key)) - 1
    rows = h.join(F.broadcast(slices), [label, "_s"]).withColumn("_n", F.col("_before") + n)
    per = F.when(F.col(label).cast("int") == 1, positives).otherwise(size - positives)
    whole = slices.select(label, F.floor(F.col("_total") / F.when(F.col(label).cast("int") == 1, positives).otherwise(size - positives)).alias("b"))
    batches = whole.distinct().agg(F.min("b").alias("_batches"))
    rows = rows.withColumn("batch", F.floor(F.col("_n") / per)).join(F.broadcast(batches))
    return rows.where(F.col("batch") < F.col("_batches")).drop("_h", "_s", "_c", "_before", "_total", "_n", "_batches")


def mixture_schedule(shares: Mapping[str, float], draws: int) -> list[str]:
    """The stream of each draw: the one furthest behind its share, ties to the first."""
    taken = dict.fromkeys(shares, 0)
    out = []
    for k in range(1, draws + 1):
        name = max(shares, key=lambda s: shares[s] * k - taken[s])
        taken[name] += 1
        out.append(name)
    return out
