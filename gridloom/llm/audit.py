"""How filters interact: what each removes, alone, in every order, and on average.

A document's failures are a mask of five bits. Four conditions are judged on
the text alone; the fifth, a text that a smaller doc_id has too, by the least
doc_id of a text, which is known by its SHA-256. Copies are counted together
before they are shuffled, so a text that a third of all documents share is a
few rows. A part's 32 cells (documents by mask) answer for all 120 orders: a
filter removes what fails it and nothing before it.

All expressions are Spark SQL functions.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LETTERS = "ABCDE"
BIT = {letter: 1 << k for k, letter in enumerate(LETTERS)}
COPY = BIT["E"]
SUMS = ("n", "good", "toxic")


def text_failures(text: Column) -> Column:
    """The bits of conditions A to D of a text; null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, capitals = F.size(words), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * capitals.cast("long") > 2 * F.length(text).cast("long"),
        "D": F.rlike(text, F.lit(r"[#$%&*|]")),
    }
    return sum((F.when(bad, BIT[k]).otherwise(0) for k, bad in fails.items()), F.lit(0))


def failure_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of a part by their failure mask, and those labelled quality = 1 and toxic = 1.

    docs(doc_id, text, source) and labels(doc_id, quality, toxic); other columns
    are ignored. A null source is the part of the empty string, a null text is
    empty. Rows that repeat a doc_id count each; of rows with one text those
    with the smallest doc_id aren't copies, repeated or not. A null doc_id is
    smaller than none and copies none. A document with several label rows is
    good, or toxic, if one of them says so; a null label or none says nothing,
    nor does one of a null doc_id. An empty table has no cells.
    """
    judged = docs.select(
        F.col("doc_id").alias("id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        text_failures(F.col("text")).alias("bits"),
        F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)).alias("key"),
    )
    judged = judged.groupBy("id", "part", "bits", "key").agg(F.count("*").alias("n"))
    said = labels.groupBy(F.col("doc_id").alias("of")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    known = judged.join(said, F.col("id") == F.col("of"), "left").select(
        "id", "part", "bits", "key", "n", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    )
    groups = known.groupBy("key", "part", "bits", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("n_least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null")
    )
    first = F.min("least").over(W.partitionBy("key"))
    copies = groups.select(
        "part", "bits", "good", "toxic", "n",
        (F.col("n") - F.col("n_null") - F.when(F.col("least") == first, F.col("n_least")).otherwise(0)).alias("copies"),
    )
    sides = F.array(
        F.struct(F.col("bits").alias("mask"), (F.col("n") - F.col("copies")).alias("n")),
        F.struct((F.col("bits") + COPY).alias("mask"), F.col("copies").alias("n")),
    )
    flat = copies.select("part", "good", "toxic", F.inline(sides))
    return flat.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")]
    )


def order_steps() -> Column:
    """array<struct(filter_order, step, bit, before)> of all orders and their steps; before: the bits of earlier filters."""
    steps = []
    for order in itertools.permutations(LETTERS):
        for k, letter in enumerate(order):
            before = sum(BIT[x] for x in order[:k])
            steps.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(BIT[letter]).alias("bit"), F.lit(before).alias("before")))
    return F.array(*steps)


def filter_interactions(cells: DataFrame) -> DataFrame:
    """A row per part, filter_order and step, from failure_cells().

    kept, removed, redundant, unique_fails, good_lost and toxic_lost of the
    step; shapley sums what its filter removes over all 120 orders: a document
    that fails m filters is removed by each of them in 120 / m orders. No cells
    give no rows.
    """
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *SUMS)).alias("cells"))  # 32 cells at most
    at = parts.select("part", "cells", F.inline(order_steps()))
    bit, before = F.col("bit"), F.col("before")

    def total(keep, value="n") -> Column:
        return F.aggregate(F.filter("cells", keep), F.lit(0).cast("long"), lambda s, c: s + (value(c) if callable(value) else c[value]))

    fails = lambda c: c["mask"].bitwiseAND(bit) != 0
    earlier = lambda c: c["mask"].bitwiseAND(before) != 0
    removed = lambda c: fails(c) & ~earlier(c)
    return at.select(
        "part",
        "filter_order",
        "step",
        total(lambda c: ~fails(c) & ~earlier(c)).alias("kept"),
        total(removed).alias("removed"),
        total(lambda c: fails(c) & earlier(c)).alias("redundant"),
        total(lambda c: c["mask"] == bit).alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
        total(fails, lambda c: c["n"] * F.element_at(F.array(*[F.lit(120 // m) for m in range(1, 6)]), F.bit_count(c["mask"]))).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """filter_interactions() of failure_cells(); their docstrings define odd rows."""
    return filter_interactions(failure_cells(docs, labels))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
m AS (
  SELECT part, doc_id,
         (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM m LEFT JOIN l USING (doc_id)),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5])::INT AS step, bits FROM o),
q AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM s),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
r AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM c, q GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""
