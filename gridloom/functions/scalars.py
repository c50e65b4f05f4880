"""Column functions: text, time, rates and intervals. All stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# All characters that count as blanks.
BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK = f"[{BLANKS}]+"


def once(x: Column, f) -> Column:
    """f(x) with x evaluated once, however often f names it and wherever the optimizer puts it."""
    return F.transform(F.array(x), f)[0]


def null_nan(x: Column) -> Column:
    """NaN is a missing number."""
    return F.when(~F.isnan(x), x)


def strip(x: Column) -> Column:
    """Blanks off both ends; the four separator controls count as blanks."""
    return F.btrim(x, F.lit(BLANKS))


def normalize_message(x: Column) -> Column:
    """Null to empty, stripped, inner blanks to one space, lower case."""
    return F.lower(F.regexp_replace(strip(F.coalesce(x, F.lit(""))), BLANK, " "))


def normalise_code(x: Column) -> Column:
    """Numeric text that is integral becomes an integer's text; other text stays, stripped."""
    text = strip(x.cast("string"))
    number = text.try_cast("double")
    whole = number.isNotNull() & (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(whole, number.cast("long").cast("string")).otherwise(text)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def epoch_seconds(ts: Column) -> Column:
    return F.floor(micros(ts) / 1_000_000).cast("long")


def step_floor(ts: Column, step: int = 600) -> Column:
    """Start of the step that holds ts, in epoch seconds."""
    us = micros(ts)
    return F.round((us - F.pmod(us, F.lit(step * 1_000_000))) / 1_000_000).cast("long")


def step_ceil(ts: Column, step: int = 600) -> Column:
    low = step_floor(ts, step)
    return F.when(micros(ts) == low * 1_000_000, low).otherwise(low + step)


def horizon_name(label_set: str, steps: int, step: int = 600) -> str:
    """Name of a label column: hours where the horizon is whole hours, else steps."""
    hours, rest = divmod(steps * step, 3600)
    return f"{label_set}_within_{hours}h" if not rest else f"{label_set}_within_{steps}steps"


def alphabetic_ratio(x: Column) -> Column:
    size = F.char_length(x)
    return F.when(size > 0, (size - F.char_length(F.regexp_replace(x, r"\p{L}+", ""))) / size).otherwise(F.lit(0.0))


def repeated_line_ratio(x: Column) -> Column:
    """Share of stripped non-empty lines whose text occurs more than once; 0 with at most one line.

    Lines that are distinct are counted by sorting them, so the cost is that of
    a sort, not of comparing all to all.
    """
    cut = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
    lines = F.array_sort(F.filter(F.transform(F.split(x, cut), strip), lambda v: v != ""))

    def share(ls: Column) -> Column:
        n = F.size(ls)
        none = F.array(F.lit(None).cast("string"))
        before = F.concat(none, F.slice(ls, F.lit(1), n - 1))
        after = F.concat(F.slice(ls, F.lit(2), n - 1), none)
        rows = F.arrays_zip(ls.alias("a"), before.alias("b"), after.alias("c"))
        twin = F.filter(rows, lambda r: F.coalesce(r["a"] == r["b"], F.lit(False)) | F.coalesce(r["a"] == r["c"], F.lit(False)))
        return F.when((n > 1) & (F.size(F.array_distinct(ls)) < n), F.size(twin) / n).otherwise(F.lit(0.0))

    return once(lines, share)


def hash_position(seed: str, text: Column) -> Column:
    """First 64 bits of SHA-256 of 'seed:text' over 2**64: a stable place in [0, 1)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), text).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def split_by_fractions(position: Column, fractions: list[tuple[str, float]]) -> Column:
    """The first split whose cumulative fraction exceeds position; the last one catches the rest."""
    out, total = None, 0.0
    for name, share in fractions[:-1]:
        total += share
        out = F.when(position < total, name) if out is None else out.when(position < total, name)
    return F.lit(fractions[-1][0]) if out is None else out.otherwise(fractions[-1][0])


def sigmoid(z: Column) -> Column:
    """Logistic function that never overflows."""
    return 0.5 * (1 + F.tanh(z / 2))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.log(q / (1 - q))


def prior_correction(trained: float, natural: float) -> float:
    """Log-odds offset from one base rate to another."""
    from math import log

    return log(natural / (1 - natural)) - log(trained / (1 - trained))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson score interval of a proportion, clipped; null on zero trials."""
    n = n.cast("double")
    p = k / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return (
        F.when(n > 0, F.greatest(F.lit(0.0), mid - half)),
        F.when(n > 0, F.least(F.lit(1.0), mid + half)),
    )


def poisson_interval(k: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Byar's approximation to the exact interval of a count."""
    k = k.cast("double")
    low = k * F.pow(1 - 1 / (9 * k) - z / (3 * F.sqrt(k)), F.lit(3.0))
    up = (k + 1) * F.pow(1 - 1 / (9 * (k + 1)) + z / (3 * F.sqrt(k + 1)), F.lit(3.0))
    return F.when(k > 0, low).otherwise(F.lit(0.0)), up


def rate_ratio(a: Column, at: Column, b: Column, bt: Column, z: float = 1.959963984540054) -> tuple[Column, Column, Column]:
    """Ratio of two rates with its log-normal interval; null if any count or exposure is zero."""
    ok = (a > 0) & (b > 0) & (at > 0) & (bt > 0)
    ratio = (a / at) / (b / bt)
    half = z * F.sqrt(1 / a + 1 / b)
    return F.when(ok, ratio), F.when(ok, ratio * F.exp(-half)), F.when(ok, ratio * F.exp(half))


def first_of_greatest(columns: list[str]) -> Column:
    """Name of the column with the greatest value; the earliest of ties; null if all are null."""
    top = F.greatest(*[F.col(c) for c in columns]) if len(columns) > 1 else F.col(columns[0])
    out = F.when(F.col(columns[0]) == top, columns[0])
    for c in columns[1:]:
        out = out.when(F.col(c) == top, c)
    return out
