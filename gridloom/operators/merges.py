"""Byte pairs learned over a table of counted pretokens, in rounds of several merges.

A round merges the best pairs that can't change each other's order: a prefix of
the pairs in their order (most frequent first, the smallest of ties), of which
none shares a symbol with another, and each is more frequent than every pair
that shares a symbol with an earlier one. A pair that a merge makes is at most
as frequent as such a neighbour, so learning one by one takes the same pairs in
the same order. Pretokens stay in the table; the driver sees the first TOP
pairs of a round. Only pretokens that hold a merged pair are counted anew.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import forget, written
from .vocab import BytePairs

TOP = 1024
ROW = "ids array<int>, n long"


def _pairs(rows: DataFrame, ids: str, sign: int) -> DataFrame:
    pairs = F.arrays_zip(F.slice(ids, F.lit(1), F.size(ids) - 1).alias("left"), F.slice(ids, F.lit(2), F.size(ids) - 1).alias("right"))
    found = rows.where(F.size(ids) > 1).select(F.explode(pairs).alias("p"), (sign * F.col("n")).alias("n"))
    return found.groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))


def next_batch(top: Sequence[tuple[int, int, int]], whole: bool, most: int) -> list[tuple[int, int]]:
    """The pairs of a round, from (left, right, n) in their order; whole: there are no others."""
    taken: list[tuple[int, int]] = []
    used: set[int] = set()
    for k, (left, right, n) in enumerate(top):
        if len(taken) == most or {left, right} & used:
            break
        # pairs behind the last one seen may share a symbol too, and be as frequent
        rivals = [m for a, b, m in top[k + 1 :] if {a, b} & used] + ([] if whole or not taken else [top[-1][2]])
        if rivals and max(rivals) >= n:
            break
        taken.append((left, right))
        used |= {left, right}
    return taken


def learn_merges(counts: DataFrame, merges: int, top: int = TOP) -> list[tuple[int, int]]:
    """Merges in their order, as BytePairs.from_pretokens() learns them, from counts(pretoken, n), each pretoken once.

    Null and empty pretokens have no pairs. It ends early when no pair is left.
    """

    def letters(batches):
        for batch in batches:
            ids = [list((t or "").encode()) for t in batch.column("pretoken").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), batch.column("n")], ["ids", "n"])

    rows = written(counts.select("pretoken", F.col("n").cast("long").alias("n")).mapInArrow(letters, ROW).where(F.size("ids") > 1), "pretokens")
    pairs = written(_pairs(rows, "ids", 1), "pairs")
    found: list[tuple[int, int]] = []
    while len(found) < merges:
        best = [tuple(r) for r in pairs.where("n > 0").orderBy(F.desc("n"), "left", "right").limit(top).collect()]  # top rows at most
        batch = next_batch(best, len(best) < top, merges - len(found))
        if not batch:
            break
        first = 256 + len(found)
        found += batch

        def merge(batches, batch=tuple(batch), first=first):
            new = {pair: first + k for k, pair in enumerate(batch)}
            for b in batches:
                out = []
                for ids in b.column("old").to_pylist():
                    hits = sorted({p for p in zip(ids, ids[1:], strict=False) if p in new}, key=new.get)
                    for pair in hits:
                        ids = BytePairs.merged(ids, pair, new[pair])
                    out.append(ids)
                yield pa.RecordBatch.from_arrays([b.column("old"), pa.array(out, pa.list_(pa.int32())), b.column("n")], ["old", "ids", "n"])

        moved = written(rows.select(F.col("ids").alias("old"), "n").mapInArrow(merge, "old array<int>, ids array<int>, n long"), "pretokens")
        changed = moved.where(F.col("old") != F.col("ids"))
        told = pairs.union(_pairs(changed, "old", -1)).union(_pairs(changed, "ids", 1))
        new_pairs = written(told.groupBy("left", "right").agg(F.sum("n").alias("n")).where("n > 0"), "pairs")
        forget(rows, pairs)
        rows, pairs = moved.select("ids", "n"), new_pairs
    forget(pairs, rows)
    return found
