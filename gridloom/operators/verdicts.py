"""Registered rules read off tables of intervals: a verdict per group, from columns low, high, delta and discarded (a share).

Rows are seeds or pairs. An interval is trusted if at most limit of its
replicates were discarded and its bounds are numbers. Fewer rows than a rule
needs is a verdict of its own, 'not formed', never a silent pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 0.01


def trusted(limit: float = LIMIT) -> Column:
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    return (F.col("discarded") <= limit) & good("low") & good("high")


def _all(condition: Column) -> Column:
    return F.coalesce(F.bool_and(F.coalesce(condition, F.lit(False))), F.lit(False))


def evaluable(base_rate: Column, limit: float = LIMIT) -> Column:
    """Whether a trusted lower bound is strictly above the base rate."""
    return F.coalesce(trusted(limit) & (F.col("low") > base_rate), F.lit(False))


def paired(deltas: DataFrame, by: Sequence[str], line: float = 0.0, comparisons: int | None = None, limit: float = LIMIT) -> DataFrame:
    """by, n, cleared, untrusted, weakest, verdict: met if every trusted lower bound is strictly above line; other than comparisons rows aren't formed."""
    clear = trusted(limit) & (F.col("low") > line)
    rows = deltas.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(clear).alias("cleared"), F.count_if(~F.coalesce(trusted(limit), F.lit(False))).alias("untrusted"), F.min("low").alias("weakest")
    )
    formed = F.col("n") == (comparisons if comparisons is not None else F.col("n"))
    return rows.withColumn("verdict", F.when(~formed, "not formed").when(F.col("cleared") == F.col("n"), "met").otherwise("not met"))


def sensitive(trained: DataFrame, controls: DataFrame, by: Sequence[str], limit: float = LIMIT) -> DataFrame:
    """by, low, control_high, verdict: sensitive if the trained lower bound is above every control's upper bound and all are trusted."""
    ok = F.coalesce(trusted(limit), F.lit(False))
    one = trained.select(*by, F.col("low").alias("low"), ok.alias("_t"))
    many = controls.groupBy(*by).agg(F.max("high").alias("control_high"), _all(trusted(limit)).alias("_c"))
    verdict = F.when(F.col("_t") & F.col("_c") & (F.col("low") > F.col("control_high")), "sensitive").otherwise("not sensitive")
    return one.join(many, list(by)).select(*by, "low", "control_high", verdict.alias("verdict"))


def axis(seeds: DataFrame, by: Sequence[str], required: int) -> DataFrame:
    """by, seeds, clearing, verdict of rows with evaluable: evaluable if at least required seeds are; fewer seeds aren't formed."""
    rows = seeds.groupBy(*by).agg(F.count("*").alias("seeds"), F.count_if("evaluable").alias("clearing"))
    return rows.withColumn("verdict", F.when(F.col("seeds") < required, "not formed").when(F.col("clearing") >= required, "evaluable").otherwise("not evaluable"))


def assignment(shift: Column, temporal: Column) -> tuple[Column, Column]:
    """The axes of the first and second hypothesis, from whether the shifted and the temporal axis are evaluable; nulls where there is none."""
    first = F.when(shift, "shift").when(temporal, "temporal")
    second = F.when(temporal, "temporal")
    return first, second


def effect(deltas: DataFrame, by: Sequence[str], lower_above: float, median_above: float, upper_below: float, limit: float = LIMIT) -> DataFrame:
    """by, median, verdict: supported (bounds and the median), refuted, both or inconclusive."""
    yes, no = trusted(limit) & (F.col("low") > lower_above), trusted(limit) & (F.col("high") < upper_below)
    rows = deltas.groupBy(*by).agg(F.percentile("delta", F.lit(0.5)).alias("median"), _all(yes).alias("_y"), _all(no).alias("_n"))
    supported = F.col("_y") & (F.col("median") > median_above)
    verdict = F.when(supported & F.col("_n"), "both").when(supported, "supported").when(F.col("_n"), "refuted").otherwise("inconclusive")
    return rows.select(*by, "median", verdict.alias("verdict"))


def ablation(deltas: DataFrame, by: Sequence[str], band: float, limit: float = LIMIT) -> DataFrame:
    """by, median, verdict: hurts, helps, equivalent, inconclusive, or as measured where two hold together."""
    t = trusted(limit)
    rows = deltas.groupBy(*by).agg(
        F.percentile("delta", F.lit(0.5)).alias("median"), _all(t & (F.col("high") < 0)).alias("_u"), _all(t & (F.col("low") > 0)).alias("_l"),
        _all(t & (F.col("low") > -band) & (F.col("high") < band)).alias("_b"),
    )
    held = F.filter(
        F.array(
            F.when(F.col("_u") & (F.col("median") < -band), "hurts"), F.when(F.col("_l") & (F.col("median") > band), "helps"), F.when(F.col("_b"), "equivalent")
        ), lambda x: x.isNotNull(),
    )
    verdict = F.when(F.size(held) > 1, "as measured").when(F.size(held) == 1, held[0]).otherwise("inconclusive")
    return rows.select(*by, "median", verdict.alias("verdict"))


def gate(upper_below: float, passed: str, failed: str, limit: float = LIMIT) -> Column:
    """untrusted, passed if the upper bound is under the line, else failed."""
    return F.when(~F.coalesce(trusted(limit), F.lit(False)), "untrusted").when(F.col("high") < upper_below, passed).otherwise(failed)


def abstention(rows: DataFrame, coverage_below: float, risk_below: float, coverage_back: float = 0.0, risk_back: float = 0.0, default: str = "inconclusive") -> DataFrame:
    """rows(gate_a, gate_b, coverage and risk: struct(low, high, trusted)) with verdict, prerequisites first."""
    c, r = F.col("coverage"), F.col("risk")
    both = c["trusted"] & r["trusted"]
    verdict = (
        F.when(F.col("gate_a") != "pass", "not evaluable").when(F.col("gate_b") != "damage", "not testable").when(~both, default)
        .when((c["high"] < coverage_below) & (r["high"] < risk_below), "supported").when((c["low"] >= coverage_back) & (r["low"] > risk_back), "refuted").otherwise(default)
    )
    return rows.withColumn("verdict", verdict)


def selection(deltas: DataFrame, cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, worse, failing, verdict: the selected step stays if a seed's upper bound is below 0 or a cell (met) fails, else the final step is fixed.

    A null interval (the same checkpoint twice) is no difference.
    """
    a = deltas.groupBy(*by).agg(F.count_if(F.col("high") < 0).alias("worse"))
    b = cells.groupBy(*by).agg(F.count_if(~F.col("met")).alias("failing"))
    verdict = F.when((F.col("worse") > 0) | (F.col("failing") > 0), "selected step").otherwise("fixed final step")
    return a.join(b, list(by)).withColumn("verdict", verdict)


def masking(rows: DataFrame, by: Sequence[str], first: Column, required: int) -> DataFrame:
    """by, clears, contains, below, clause of rows with position: the first clause (only where first holds) or the second that required seeds meet."""
    n = {k: F.count_if(F.col("position") == k).alias(k) for k in ("clears", "contains", "below")}
    out = rows.withColumn("_f", first).groupBy(*by, "_f").agg(*n.values())
    clause = F.when(F.col("_f") & (F.col("clears") >= required), "first").when(F.col("contains") >= required, "second").otherwise("neither")
    return out.withColumn("clause", clause).drop("_f")


def band(rate: Column, shift: Column, low: float, high: float) -> Column:
    """struct(inside, shift): inside the closed band nothing is shifted."""
    inside = rate.between(low, high)
    return F.struct(inside.alias("inside"), F.when(inside, F.lit(0.0)).otherwise(shift).alias("shift"))


def seed_gap(first: Column, second: Column, line: float) -> Column:
    """uninformative if two seeds are a line or more apart; a missing one is an error."""
    missing = first.isNull() | F.isnan(first) | second.isNull() | F.isnan(second)
    told = F.when(F.abs(first - second) >= line, "uninformative").otherwise("informative")
    return F.when(missing, F.raise_error(F.lit("a seed has no value")).cast("string")).otherwise(told)


def same_rows(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of columns that only one side has, or has more often: none if both cover the same rows."""
    x, y = a.select(*columns), b.select(*columns)
    return x.exceptAll(y).withColumn("side", F.lit("first")).unionByName(y.exceptAll(x).withColumn("side", F.lit("second")))
