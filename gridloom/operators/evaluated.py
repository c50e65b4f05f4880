"""Joins of scored rows to a window index that refuse what doesn't fit, inside the plan.

A row that one side lacks, or has twice, or whose facts differ is an error that
names it when the result is read; nothing is counted on the driver for that.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _named(keys: Sequence[str]) -> Column:
    return F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in keys])


def once(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """df; a row whose keys another row has too is an error that names them."""
    n = F.count("*").over(W.partitionBy(*keys))
    checked = F.when(n > 1, F.raise_error(F.concat(F.lit(f"repeated in {what}: "), _named(keys))).cast("boolean")).otherwise(F.lit(True))
    return df.withColumn("_once", checked).where("_once").drop("_once")


def evaluated_rows(scores: DataFrame, index: DataFrame, keys: Sequence[str], same: Mapping[str, str] | None = None, observation: Observation | None = None) -> DataFrame:
    """scores joined to index by keys, each row of either side once and in both.

    same maps columns of scores to columns of index that must agree, nulls
    equal. Extra columns of index follow; those that scores has already must be
    in keys or same. observation, if given, gets rows and unlabelled (rows
    whose index columns hold a null) once the result was read. Keys with nulls
    are keys.
    """
    keys, same = list(keys), dict(same or {})
    left = once(scores, keys, "the scores").withColumn("_s", F.lit(True))
    right = once(index, keys, "the index").withColumn("_i", F.lit(True))
    right = right.withColumnsRenamed({c: f"_i_{c}" for c in index.columns})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_i_{k}"))
    both = left.join(right, on, "full")
    name = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(F.coalesce(F.col(k), F.col(f"_i_{k}")).cast("string"), F.lit("null"))) for k in keys])
    wrong = F.when(F.col("_i").isNull(), F.concat(F.lit("not in the index: "), name)).when(F.col("_s").isNull(), F.concat(F.lit("not scored: "), name))
    for a, b in same.items():
        wrong = wrong.when(~F.col(a).eqNullSafe(F.col(f"_i_{b}")), F.concat(F.lit(f"{a} differs: "), name))
    fits = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(F.lit(True))
    more = [c for c in index.columns if c not in keys and c not in same.values()]
    out = both.withColumn("_fits", fits).where("_fits").select(*scores.columns, *[F.col(f"_i_{c}").alias(c) for c in more])
    if observation is not None:
        unknown = F.lit(False)
        for c in more:
            unknown = unknown | F.col(c).isNull()
        out = out.observe(observation, F.count("*").alias("rows"), F.count_if(unknown).alias("unlabelled"))
    return out


def relabelled(scores: DataFrame, index: DataFrame, keys: Sequence[str], label: str, other: str) -> DataFrame:
    """scores with other and <other>_known from the index, whose label must be that of scores; other is false where it isn't known."""
    joined = evaluated_rows(scores, index.select(*keys, label, other, f"{other}_known"), keys, {label: label})
    return joined.withColumn(other, F.coalesce(F.col(other), F.lit(False)) & F.col(f"{other}_known"))
