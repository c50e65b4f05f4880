"""Quantile bins and the joint id space of channel, bin, time and text tokens."""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import quantiles as Q
from .tables import written

# Sizes of the blocks of ids, in order.
BLOCKS = (("special", 32), ("channel", 64), ("bin", 1024), ("time", 64), ("text", 32768))


def fit_edges(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """by, edges: interior quantile edges without repeats, by linear interpolation."""
    probabilities = [k / bins for k in range(1, bins)]
    found = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(p) for p in probabilities])).alias("edges"))
    return found.withColumn("edges", F.array_sort(F.array_distinct("edges")))


def point_masses(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Values that hold at least 1/bins of all rows, the heaviest first, at most a quarter of the bins."""
    counted = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    heavy = counted.join(F.broadcast(total)).where(F.col("n") >= F.col("total") / bins)
    return heavy.orderBy(F.desc("n"), value).limit(bins // 4).select(value, "n")


def bin_of(x: Column, edges: Column) -> Column:
    """Number of edges at most x; -1 if x is missing."""
    return F.when(x.isNull() | F.isnan(x), -1).otherwise(F.size(F.filter(edges, lambda e: e <= x)))


def representatives(df: DataFrame, value: str, bin_column: str) -> DataFrame:
    """bin, rep: the mean of each bin's values."""
    return df.where(F.col(bin_column) >= 0).groupBy(bin_column).agg(F.avg(value).alias("rep"), F.count("*").alias("n"))


def offset_of(block: str) -> int:
    at = 0
    for name, size in BLOCKS:
        if name == block:
            return at
        at += size
    raise KeyError(block)


def to_global(block: str, local: Column) -> Column:
    size = dict(BLOCKS)[block]
    bad = (local < 0) | (local >= size)
    return F.when(bad, F.raise_error(F.lit(f"id outside of block {block}")).cast("int")).otherwise(local + offset_of(block)).cast("int")


def decode_id(x: Column) -> tuple[Column, Column]:
    """Block and local id of a global id; nulls outside of all blocks."""
    name, local = F.lit(None).cast("string"), F.lit(None).cast("int")
    for block, size in BLOCKS:
        at = offset_of(block)
        hit = x.between(at, at + size - 1)
        name, local = F.when(hit, block).otherwise(name), F.when(hit, x - at).otherwise(local)
    return name, local


def encode_step(columns: Sequence[Column], masked: Sequence[int] = (), separator: int = 1, missing: int = 2) -> Column:
    """array: a separator and one bin id per channel; masked channels and missing bins get the missing id."""
    parts = [
        F.lit(missing) if k in masked else F.when(c < 0, F.lit(missing)).otherwise(to_global("bin", c)) for k, c in enumerate(columns)
    ]
    return F.array(F.lit(separator), *parts)


def interleave(steps: DataFrame, messages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, step, tokens, offset: each step's tokens, then its messages' in their order, and where they start in the key's stream.

    steps has (keys, step, tokens); messages has (keys, step, position, tokens).
    """
    said = messages.groupBy(*keys, "step").agg(F.array_sort(F.collect_list(F.struct("position", "tokens"))).alias("m"))
    joined = steps.join(said, [*keys, "step"], "left")
    more = F.flatten(F.transform(F.coalesce("m", F.array().cast(said.schema["m"].dataType)), lambda v: v["tokens"]))
    joined = joined.withColumn("tokens", F.concat("tokens", more)).drop("m")
    before = W.partitionBy(*keys).orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    return joined.withColumn("offset", F.coalesce(F.sum(F.size("tokens")).over(before), F.lit(0)))


def tail_windows(steps: DataFrame, keys: list[str], context: int) -> DataFrame:
    """first_step of the longest tail of whole steps, ending with each step, whose tokens fit in context.

    Steps are unioned with the places where a window may begin at the earliest
    and read backwards, so each looks at what came before in that order.
    """
    ended = steps.withColumn("_end", F.col("offset") + F.col("size"))
    starts = ended.select(*keys, F.lit(None).cast(ended.schema["step"].dataType).alias("step"), F.col("offset").alias("_x"), F.col("step").alias("_s"))
    probe = ended.select(*keys, "step", (F.col("_end") - context).alias("_x"), F.lit(None).cast(ended.schema["step"].dataType).alias("_s"))
    ahead = W.partitionBy(*keys).orderBy(F.desc("_x")).rangeBetween(W.unboundedPreceding, 0)
    found = probe.unionByName(starts).withColumn("first_step", F.min("_s").over(ahead)).where("step is not null")
    return found.select(*keys, "step", F.when(F.col("first_step") <= F.col("step"), F.col("first_step")).alias("first_step"))


def tiles(tokens: Column, context: int) -> Column:
    return F.when(tokens >= context, F.sequence(F.lit(0), tokens - context, F.lit(context))).otherwise(F.array().cast("array<bigint>"))


@dataclass(frozen=True)
class BinRule:
    """How a channel's bins are laid.

    bins is the most bins of a channel. With masses, values that hold at least
    1/bins of all rows get a bin of their own, at most most_masses and a quarter
    of the bins, the heaviest first. tail_bins bins of equal width lie on each
    side beyond the tail and 1 - tail quantiles, and the outermost of them are
    joined inward until they hold the share floor. All bins left go to quantiles
    of the middle.
    """

    bins: int = 64
    masses: bool = False
    most_masses: int | None = None
    tail_bins: int = 0
    tail: float = 0.005
    floor: float = 0.0


class Counted:
    """Sorted distinct values with their counts; ranks and quantiles of the rows they stand for."""

    def __init__(self, values: np.ndarray, counts: np.ndarray):
        order = np.argsort(values)
        self.values, self.counts = values[order], counts[order]
        self.upto = np.cumsum(self.counts)
        self.n = int(self.upto[-1]) if len(self.upto) else 0

    def quantiles(self, shares: np.ndarray) -> np.ndarray:
        """By linear interpolation between ranks."""
        place = np.asarray(shares) * (self.n - 1)
        at = np.floor(place).astype(np.int64)
        here = self.values[np.searchsorted(self.upto, at, "right")]
        after = self.values[np.searchsorted(self.upto, np.minimum(at + 1, self.n - 1), "right")]
        return here + (place - at) * (after - here)

    @property
    def low(self) -> float:
        return float(self.values[0])

    @property
    def high(self) -> float:
        return float(self.values[-1])

    def below(self, x: np.ndarray) -> np.ndarray:
        """Rows under each x."""
        return np.concatenate([[0], self.upto])[np.searchsorted(self.values, x)]

    def where(self, keep: np.ndarray) -> Counted:
        return Counted(self.values[keep], self.counts[keep])

    def masses(self, rule: BinRule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return mass_spans(self, rule)

    def middle(self, masses: np.ndarray, low: float, high: float, parts: Sequence[int]) -> Counted:
        """Rows from low to high that are no masses; parts are the numbers of parts that may be asked for."""
        return self.where(~np.isin(self.values, masses) & (self.values >= low) & (self.values <= high))


class Unknown(Exception):
    """A fact about a channel that Facts doesn't have: rank, below, middle or middle rank, and for which numbers."""

    def __init__(self, kind: str, at: Sequence[float]):
        super().__init__(kind)
        self.kind, self.at = kind, [float(x) for x in at]


class Facts:
    """As Counted, from single facts about a channel that never is in one place; one that is missing raises Unknown."""

    def __init__(self, rows: pd.DataFrame, part: str = ""):
        self.rows, self.part = rows, part
        self.known = {k: dict(zip(g["at"], g["value"], strict=True)) for k, g in rows.groupby("kind")}
        self.n = int(self.known["middle" if part else "rows"][0.0])
        if not part:
            self.low, self.high = self.known["low"][0.0], self.known["high"][0.0]

    def _get(self, kind: str, at: np.ndarray) -> np.ndarray:
        have = self.known.get(kind, {})
        if missing := sorted({float(x) for x in at} - have.keys()):
            raise Unknown(kind, missing)
        return np.array([have[float(x)] for x in at], float)

    def quantiles(self, shares: np.ndarray) -> np.ndarray:
        place = np.asarray(shares) * (self.n - 1)
        at = np.floor(place)
        both = self._get(self.part + "rank", np.concatenate([at, np.minimum(at + 1, self.n - 1)]))
        here, after = np.split(both, 2)
        return here + (place - at) * (after - here)

    def below(self, x: np.ndarray) -> np.ndarray:
        return self._get("below", x).astype(np.int64)

    def masses(self, rule: BinRule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.array(sorted(self.known.get("begin", {})), float)
        return at, self._get("begin", at), self._get("end", at)

    def middle(self, masses: np.ndarray, low: float, high: float, parts: Sequence[int]) -> Facts:
        if "middle" not in self.known:
            raise Unknown("middle", [low, high])
        inside = Facts(self.rows, "middle ")
        if inside.n:
            inside.quantiles(np.unique(np.concatenate([[0.0], *[np.arange(1, k) / k for k in parts if k > 1]])))
        return inside


def mass_spans(rows: Counted, rule: BinRule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Heavy values, and where their bins begin and end: halfway to the neighbours, without end at the range's ends."""
    at = np.flatnonzero(rows.counts * rule.bins >= rows.n) if rule.masses else np.zeros(0, int)
    most = rule.bins // 4 if rule.most_masses is None else min(rule.most_masses, rule.bins // 4)
    at = np.sort(at[np.lexsort([-at, -rows.counts[at]])][:most])
    halfway = np.concatenate([[-np.inf], (rows.values[1:] + rows.values[:-1]) / 2, [np.inf]])
    return rows.values[at], halfway[at], halfway[at + 1]


def inner_cuts(cuts: Sequence[float], outside: Sequence[int], least: int) -> list[float]:
    """A side's cuts, outermost first, without those beyond which fewer than least rows lie; the innermost stays.

    outside[k] is the number of rows beyond cuts[k].
    """
    first = next((k for k, n in enumerate(outside) if n >= least), len(cuts))
    return list(cuts[min(first, len(cuts) - 1) :]) if cuts else []


def merge_outward(cuts: Sequence[float], counts: Sequence[int], floor: int) -> list[float]:
    """Drops cuts so that outer bins hold at least floor rows; counts has one entry per bin, one more than cuts."""
    upto = np.cumsum(counts)
    lower = np.flatnonzero(upto[:-1] >= floor)
    upper = np.flatnonzero(upto[-1] - upto[:-1] >= floor)
    return list(cuts[lower[0] : upper[-1] + 1]) if len(lower) and len(upper) else []


def lay_bins(rows: Counted | Facts, rule: BinRule) -> dict:
    """edges (both ends of the range included), reps, masses, tail_low, tail_high, and per side how many tail bins there are and were merged."""
    low, high = rows.low, rows.high
    masses, begin, end = rows.masses(rule)
    spans = np.concatenate([begin[begin > -np.inf], end[end < np.inf]])
    free = lambda cuts: cuts[~((cuts[:, None] >= begin) & (cuts[:, None] <= end)).any(axis=1)]
    inner, tails, merged = [low, high], [], [0, 0]
    if rule.tail_bins:
        least = math.ceil(rule.floor * rows.n)
        edge = rows.quantiles(np.array([rule.tail, 1 - rule.tail]))
        for side, (outer, limit) in enumerate(((low, edge[0]), (high, edge[1]))):
            if limit == outer:
                continue
            inner[side] = float(limit)
            cuts = free(outer + (limit - outer) * np.arange(1, rule.tail_bins + 1) / rule.tail_bins)
            # a mass beyond a cut bounds the outermost bin: no merge widens it
            bounded = [bool((spans < c).any() if side == 0 else (spans > c).any()) for c in cuts]
            under = rows.below(cuts)
            outside = [rows.n if b else int(u if side == 0 else rows.n - u) for u, b in zip(under, bounded, strict=True)]
            left = inner_cuts(cuts.tolist(), outside, least)
            merged[side] = len(cuts) - len(left)
            tails += left
    fixed = np.unique(np.concatenate([spans, np.array(tails, float)]))
    fixed = fixed[(fixed > low) & (fixed < high)]
    if len(fixed) + 1 > rule.bins:
        raise ValueError(f"{len(fixed) + 1} bins of masses and tails don't fit in {rule.bins}")
    special = bool(masses.size or rule.tail_bins)
    # fewer parts than these can't fill all bins, as each fixed cut and each part's adds one at most
    least_parts = max(2, rule.bins - len(fixed) + 1)
    middle = rows.middle(masses, inner[0], inner[1], range(least_parts - 1, rule.bins + 1)) if special else rows

    def cuts_with(parts: int) -> np.ndarray:
        cuts = free(middle.quantiles(np.arange(1, parts) / parts)) if middle.n and parts > 1 else np.zeros(0)
        cuts = np.unique(np.concatenate([fixed, cuts]))
        return cuts[(cuts > low) & (cuts < high)]

    if special:
        parts = bisect.bisect_left(range(least_parts, rule.bins + 1), True, key=lambda k: len(cuts_with(k)) >= rule.bins) + least_parts - 1
        edges = np.concatenate([[low], cuts_with(parts), [high]])
    else:
        edges = rows.quantiles(np.arange(rule.bins + 1) / rule.bins)
    reps = (edges[1:] + edges[:-1]) / 2 if len(edges) > 1 else edges
    reps[np.searchsorted(edges[1:-1], masses, "right")] = masses
    return {
        "edges": edges.tolist(), "reps": reps.tolist(), "masses": masses.tolist(), "tail_low": inner[0], "tail_high": inner[1],
        "lower_bins": int((edges <= inner[0]).sum()) - 1, "upper_bins": int((edges >= inner[1]).sum()) - 1, "lower_merged": merged[0], "upper_merged": merged[1],
    }


BINS_SCHEMA = (
    "edges array<double>, reps array<double>, masses array<double>, tail_low double, tail_high double, "
    "lower_bins long, upper_bins long, lower_merged long, upper_merged long"
)


#: Distinct values of a channel up to which one task lays its bins from all of them.
HELD = 1 << 16


def fit_bins(values: DataFrame, rule: BinRule, sample_rows: int | None = None, seed: int = 0, held: int = HELD) -> DataFrame:
    """channel and BINS_SCHEMA of each channel of values(channel, value); missing and non-finite values are left out.

    Rows are counted per distinct value first. A channel of at most held of
    them is laid by one task. Others never are in one place: the bins are laid
    from single facts (values at ranks, rows below cuts), and facts that turn
    out to be missing are found for all channels at once, in a few rounds.
    Both ways lay the same bins. sample_rows fits on so many rows of each
    channel, about, chosen by a hash.
    """
    rows = values.select(F.col("channel").alias("group"), "value")
    if sample_rows is not None:
        sizes = rows.groupBy("group").agg(F.count("*").alias("_n"))
        place = F.pmod(F.xxhash64("group", "value", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
        rows = rows.join(sizes, "group").where(place * F.col("_n") < sample_rows).select("group", "value")
    counted = written(Q.count_values(rows), "counted")
    sizes = written(Q.totals(counted), "channels")

    def lay(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"channel": pdf["group"].iloc[0], **lay_bins(Counted(pdf["value"].to_numpy(), pdf["n"].to_numpy()), rule)}])

    schema = f"channel {values.schema['channel'].dataType.simpleString()}, {BINS_SCHEMA}"
    few = _of_groups(counted, sizes.where(F.col("n_values") <= held).select("group")).groupBy("group").applyInPandas(lay, schema)
    large = sizes.where(F.col("n_values") > held)
    if not large.limit(1).count():
        return few
    return few.union(_lay_by_facts(written(_of_groups(counted, large.select("group")), "counted"), large, rule, schema))


def _of_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    own = groups.select(*[F.col(c).alias(f"_{c}") for c in groups.columns])
    return rows.join(own, F.col("group").eqNullSafe(F.col("_group"))).drop("_group")


def _lay_by_facts(counted: DataFrame, sizes: DataFrame, rule: BinRule, schema: str) -> DataFrame:
    """Bins of channels too large for a task; no more facts of a channel are gathered than its rule asks for."""
    fact = lambda kind, at, value: F.struct(F.lit(kind).alias("kind"), at.cast("double").alias("at"), value.cast("double").alias("value"))
    zero = F.lit(0.0)
    facts = sizes.select("group", F.inline(F.array(*[fact(c, zero, F.col(c)) for c in ("rows", "low", "high")])))
    heavy = None
    if rule.masses:
        most = rule.bins // 4 if rule.most_masses is None else min(rule.most_masses, rule.bins // 4)
        first = W.partitionBy("group").orderBy(F.desc("n"), F.desc("value"))  # at most bins values a group are heavy
        heavy = _of_groups(counted, sizes.select("group", "rows")).where(F.col("n") * rule.bins >= F.col("_rows"))
        heavy = written(heavy.withColumn("place", F.row_number().over(first)).where(F.col("place") <= most).select("group", "value"), "masses")
        facts = facts.union(_mass_facts(counted, heavy, fact))
    facts = written(facts, "facts")
    asked_kind = f"group {schema.split(',')[0].split(' ', 1)[1]}, kind string, at array<double>, laid struct<{BINS_SCHEMA.replace(' ', ':').replace(',:', ',')}>"

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {"group": pdf["group"].iloc[0], "kind": "laid", "at": [], "laid": None}
        try:
            row["laid"] = lay_bins(Facts(pdf), rule)
        except Unknown as missing:
            row |= {"kind": missing.kind, "at": missing.at}
        return pd.DataFrame([row])

    middle = None
    for _ in range(6):  # tails, rows below their cuts, size of the middle, its ranks
        asked = written(facts.groupBy("group").applyInPandas(ask, asked_kind), "asked")
        kinds = {r["kind"] for r in asked.select("kind").distinct().collect()}
        if kinds <= {"laid"}:
            return asked.select(F.col("group").alias("channel"), "laid.*")
        of = lambda kind: asked.where(F.col("kind") == kind)  # noqa: E731, B023
        if "rank" in kinds:
            ranks = Q.order_statistics(counted, of("rank").select("group", F.explode("at").alias("rank")))
            facts = facts.union(ranks.select("group", F.inline(F.array(fact("rank", F.col("rank"), F.col("value"))))))
        if "below" in kinds:
            cuts = written(of("below").select("group", F.array_sort("at").alias("cuts")), "cuts")
            slots = Q.slots(counted, cuts).groupBy("group").agg(F.collect_list(F.struct("slot", "n")).alias("slots"))
            under = _of_groups(cuts, slots).select("group", "_slots", F.posexplode("cuts").alias("k", "cut"))
            sums = F.aggregate(F.filter("_slots", lambda x: x["slot"] <= F.col("k")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
            facts = facts.union(under.select("group", F.inline(F.array(fact("below", F.col("cut"), sums)))))
        if "middle" in kinds:
            ends = written(of("middle").select("group", F.col("at")[0].alias("lo"), F.col("at")[1].alias("hi")), "middle")
            inside = _of_groups(counted, ends).where(F.col("value").between(F.col("_lo"), F.col("_hi"))).select("group", "value", "n")
            if heavy is not None:
                own = heavy.select(F.col("group").alias("_group"), F.col("value").alias("_value"))
                inside = inside.join(own, F.col("group").eqNullSafe(F.col("_group")) & (F.col("value") == F.col("_value")), "left_anti")
            inside = written(inside, "middle")
            middle = inside if middle is None else middle.union(inside)
            held = _of_groups(ends.join(inside.groupBy("group").agg(F.sum("n").alias("n")).withColumnRenamed("group", "_g"), F.col("group").eqNullSafe(F.col("_g")), "left").select("group", "n"), ends.select("group"))
            facts = facts.union(held.select("group", F.inline(F.array(fact("middle", zero, F.coalesce("n", F.lit(0)))))))
        if "middle rank" in kinds:
            ranks = Q.order_statistics(middle, of("middle rank").select("group", F.explode("at").alias("rank")))
            facts = facts.union(ranks.select("group", F.inline(F.array(fact("middle rank", F.col("rank"), F.col("value"))))))
        facts = written(facts, "facts")
    raise RuntimeError("facts still missing")


def _mass_facts(counted: DataFrame, heavy: DataFrame, fact) -> DataFrame:
    """Where the bins of heavy values begin and end: halfway to the neighbouring values, infinite at a channel's ends."""
    cuts = written(heavy.groupBy("group").agg(F.array_sort(F.collect_list("value")).alias("cuts")), "masses")
    own = heavy.select(F.col("group").alias("_group"), F.col("value").alias("_value"))
    others = counted.join(own, F.col("group").eqNullSafe(F.col("_group")) & (F.col("value") == F.col("_value")), "left_anti")
    slots = Q.slots(others, cuts).groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("least", "most").alias("x")))).alias("slots"))
    at = cuts.join(slots.withColumnRenamed("group", "_g"), F.col("group").eqNullSafe(F.col("_g")), "left").select("group", "cuts", "slots", F.posexplode("cuts").alias("k", "v"))
    k, v, inf = F.col("k"), F.col("v"), F.lit(float("inf"))
    before = F.coalesce(F.try_element_at("slots", k)["most"], F.when(k > 0, F.try_element_at("cuts", k)))
    after = F.coalesce(F.try_element_at("slots", k + 1)["least"], F.try_element_at("cuts", k + 2))
    begin, end = F.coalesce((before + v) / 2, -inf), F.coalesce((v + after) / 2, inf)
    return at.select("group", F.inline(F.array(fact("begin", v, begin), fact("end", v, end))))


def clamped_bin(x: Column, edges: Column) -> Column:
    """Bin of x among edges that include both ends of the range; values beyond fall in the outer bins; -1 if x is missing or not finite."""
    interior = F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), -1).otherwise(F.size(F.filter(interior, lambda e: e <= x)))


def transform(wide: DataFrame, channels: Sequence[str], fitted: DataFrame) -> DataFrame:
    """Adds <channel>__bin for each channel; -1 throughout for one that is absent from wide or from fitted.

    fitted has one row per channel, so all edges travel in the plan as one broadcast row.
    """
    table = fitted.where(F.col("channel").isin(*channels)).agg(F.map_from_entries(F.collect_list(F.struct("channel", "edges"))).alias("_edges"))
    rows = wide.crossJoin(F.broadcast(table))
    there = {c for c in channels if c in wide.columns}
    bins = {f"{c}__bin": F.coalesce(clamped_bin(F.col(c).cast("double"), F.col("_edges")[c]), F.lit(-1)) if c in there else F.lit(-1) for c in channels}
    return rows.withColumns(bins).drop("_edges")


def inverse(bins: DataFrame, fitted: DataFrame, name: str = "value") -> DataFrame:
    """bins(channel, bin, ...) with the representative of each bin; null for -1."""
    rows = bins.join(F.broadcast(fitted.select("channel", "reps")), "channel", "left")
    place = F.greatest(F.least(F.col("bin"), F.size("reps") - 1), F.lit(0)) + 1
    return rows.withColumn(name, F.when(F.col("bin") >= 0, F.element_at("reps", place.cast("int")))).drop("reps")


def bin_fit(values: DataFrame, fitted: DataFrame) -> DataFrame:
    """channel, split, n, iqr, bins_used, mass_share, first_share, last_share, error, relative_error of values(channel, split, value).

    error is the mean absolute distance to the representatives; relative to the
    quartile distance of the channel's rows of split 'train'.
    """
    rows = values.join(F.broadcast(fitted), "channel").withColumn("bin", clamped_bin(F.col("value"), F.col("edges"))).where("bin >= 0")
    rep = F.element_at("reps", (F.col("bin") + 1).cast("int"))
    share = lambda c: F.avg(c.cast("double"))
    out = rows.groupBy("channel", "split").agg(
        F.count("*").alias("n"), F.count_distinct("bin").alias("bins_used"), share(F.array_contains("masses", F.col("value"))).alias("mass_share"),
        share(F.col("bin") == 0).alias("first_share"), share(F.col("bin") == F.size("reps") - 1).alias("last_share"), F.avg(F.abs(F.col("value") - rep)).alias("error"),
    )
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75)))
    spread = rows.where("split = 'train'").groupBy("channel").agg(q.alias("_q")).select("channel", (F.col("_q")[1] - F.col("_q")[0]).alias("iqr"))
    return out.join(F.broadcast(spread), "channel", "left").withColumn("relative_error", F.when(F.col("iqr") > 0, F.col("error") / F.col("iqr")))


def tail_occupancy(values: DataFrame, fitted: DataFrame) -> DataFrame:
    """channel, side, bin, n: rows in each bin of the fixed-width tails, empty ones too."""
    below = F.transform(F.sequence(F.lit(0), F.col("lower_bins") - 1), lambda b: F.struct(F.lit("lower").alias("side"), b.cast("int").alias("bin")))
    last = F.size("reps") - 1
    above = F.transform(F.sequence(last - F.col("upper_bins") + 1, last), lambda b: F.struct(F.lit("upper").alias("side"), b.cast("int").alias("bin")))
    none = F.array().cast("array<struct<side:string,bin:int>>")
    all_bins = F.concat(F.when(F.col("lower_bins") > 0, below).otherwise(none), F.when(F.col("upper_bins") > 0, above).otherwise(none))
    wanted = fitted.select("channel", F.explode(all_bins).alias("x")).select("channel", "x.side", "x.bin")
    rows = values.join(F.broadcast(fitted.select("channel", "edges")), "channel").select("channel", clamped_bin(F.col("value"), F.col("edges")).alias("bin"))
    counts = rows.groupBy("channel", "bin").agg(F.count("*").alias("n"))
    return wanted.join(counts, ["channel", "bin"], "left").select("channel", "side", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def out_of_range(values: DataFrame, fitted: DataFrame, by: Sequence[str]) -> DataFrame:
    """channel, by, n, below, above: rows outside of the range that the bins were fitted on."""
    rows = values.join(F.broadcast(fitted.select("channel", "edges")), "channel")
    v = F.col("value")
    return rows.where(v.isNotNull() & ~F.isnan(v)).groupBy("channel", *by).agg(
        F.count("*").alias("n"), F.count_if(v < F.element_at("edges", 1)).alias("below"), F.count_if(v > F.element_at("edges", -1)).alias("above")
    )


def fit_channel(df: DataFrame, value: str, bins: int, tail: float = 0.005, tail_bins: int = 0, floor: int = 1) -> list[float]:
    """Interior edges of one channel with masses and tails; outer bins hold at least floor rows where tails allow it."""
    values = df.select(F.lit("x").alias("channel"), F.col(value).cast("double").alias("value"))
    rows = values.where("value is not null").count()
    found = fit_bins(values, BinRule(bins, True, None, tail_bins, tail, floor / max(rows, 1))).first()
    return found["edges"][1:-1] if found else []
