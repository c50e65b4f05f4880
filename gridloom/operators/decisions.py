"""Verdict rules over intervals and counts; plain functions of few numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Interval:
    low: float
    high: float
    discarded: float = 0.0

    def trusted(self, limit: float = 0.01) -> bool:
        return self.discarded <= limit and self.low == self.low and self.high == self.high


def position(i: Interval, line: float) -> str:
    """clears if the trusted lower bound is above the line, below if the upper one is under it."""
    return "clears" if i.low > line and i.trusted() else "below" if i.high < line else "contains"


def evaluable(i: Interval, base_rate: float) -> bool:
    return i.trusted() and i.low > base_rate


def all_positive(intervals: Sequence[Interval]) -> tuple[bool, float]:
    """Whether every trusted lower bound is above 0, and the lowest bound."""
    lowest = min(i.low for i in intervals)
    return all(i.trusted() and i.low > 0 for i in intervals), lowest


def supported(intervals: Sequence[Interval], effects: Sequence[float], x: float, y: float, z: float) -> str:
    """supported, refuted, both or neither, from bounds and the median effect."""
    middle = sorted(effects)[(len(effects) - 1) // 2] if len(effects) % 2 else sum(sorted(effects)[len(effects) // 2 - 1 : len(effects) // 2 + 1]) / 2
    yes = all(i.trusted() and i.low > x for i in intervals) and middle > y
    no = all(i.trusted() and i.high < z for i in intervals)
    return "both" if yes and no else "supported" if yes else "refuted" if no else "neither"


def gate(i: Interval, limit: float, failure: str) -> str:
    return "untrusted" if not i.trusted() else "pass" if i.high < limit else failure


def axis(verdicts: Sequence[bool], required: int) -> bool:
    """Evaluable if enough seeds are; too few seeds are an error."""
    if len(verdicts) < required:
        raise ValueError(f"{len(verdicts)} seeds, {required} needed")
    return sum(verdicts) >= required


def move(before: int, after: int, frequent: int) -> str:
    """How a count changed against a line, in five kinds."""
    if before == 0:
        return "appears" if after else "absent"
    if before < frequent <= after:
        return "rises"
    if after < frequent <= before:
        return "falls"
    return "stays"


def missing_columns(required: Sequence[str], present: Sequence[str]) -> list[str]:
    return [c for c in required if c not in set(present)]


def disjoint(blocks: Mapping[str, tuple[int, int]]) -> bool:
    """Whether half-open id ranges don't meet."""
    spans = sorted(blocks.values())
    return all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
