"""Array functions over token streams: separators, message spans, masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def positions(tokens: Column, wanted: int) -> Column:
    """Positions (from 0) of a token."""
    return F.array_compact(F.transform(tokens, lambda x, i: F.when(x == wanted, i)))


def message_spans(tokens: Column, opens: int, closes: int) -> Column:
    """array of struct(a, b): positions of each open and close token; null if they don't pair or nest."""
    a, b = positions(tokens, opens), positions(tokens, closes)
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    fits = (F.size(a) == F.size(b)) & F.forall(pairs, lambda p: p["a"] < p["b"])
    apart = F.forall(F.transform(pairs, lambda p, i: (i == 0) | F.coalesce(p["a"] > F.element_at(b, F.greatest(i, F.lit(1))), F.lit(True))), lambda ok: ok)
    return F.when(fits & apart, pairs)


def drop_spans(tokens: Column, spans: Column) -> Column:
    """Tokens outside of all spans, both ends counted in."""
    kept = F.transform(tokens, lambda x, i: F.when(~F.exists(spans, lambda s: (i >= s["a"]) & (i <= s["b"])), x))
    return F.array_compact(kept)


def mask_channels(tokens: Column, channels: Sequence[int], per_step: int, missing: int) -> Column:
    """Overwrites chosen places of every step of per_step tokens."""
    return F.transform(tokens, lambda x, i: F.when((i % per_step).isin(*channels), missing).otherwise(x))


def token_counts(df: DataFrame, tokens: str) -> DataFrame:
    """token, n over all streams."""
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def rare_tokens(counts: DataFrame, vocabulary: int, under: int) -> DataFrame:
    """token, n of all ids below vocabulary with n under a bound, never-seen ids too."""
    ids = counts.sparkSession.range(vocabulary).select(F.col("id").cast("int").alias("token"))
    return ids.join(counts, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < under)


def bag_of_tokens(df: DataFrame, keys: Sequence[str], tokens: str, special_below: int) -> DataFrame:
    """keys, token, share: counts of ordinary tokens over the number of separators (token 1)."""
    steps = F.size(positions(F.col(tokens), 1))
    spread = df.select(*keys, steps.alias("_steps"), F.explode(tokens).alias("token")).where(F.col("token") >= special_below)
    return spread.groupBy(*keys, "token").agg((F.count("*") / F.max("_steps")).alias("share"))
