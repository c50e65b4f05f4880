"""Mixing sources to target weights by hash-random order and prefix sums.

Sources get a share of all words by weight, capped at a number of epochs of
their own words, the excess going to the others by weight. Inside a source the
documents stand in the order of md5(doc_id); whole epochs are repeated and the
rest is cut at the exact word where the running sum meets the budget.

No source is gathered in one task: a source is cut by leading hex digits of its
keys into leaves of about LEAF rows, sums of leaves are accumulated first, and
running sums are made inside each leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import materialize
from .textcore import free_name

WORD = r"[^\x20\x09-\x0D]+"
LEAF = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """Adds weight and target (double) to rows of (source, source_size, n_docs).

    totals has one row per source. Sources are ranked by code point, null last,
    and take the weights in turn. Sources sorted by cap * size / weight meet
    their cap in that order, so the capped ones are a prefix of it.
    """
    ranked = totals.withColumn("_rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    picks = F.array(*[F.lit(int(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(picks, (F.col("_rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_most", (F.col("source_size") * cap).cast("double"))
    ranked = ranked.withColumn("_total", F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)))
    by_ratio = W.orderBy(F.col("_most") / F.col("weight"), F.col("_rank"))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, W.unboundedFollowing)
    ranked = ranked.withColumn(
        "_full",
        F.col("_most") * F.sum("weight").over(onward)
        <= F.col("weight") * (F.col("_total") - F.coalesce(F.sum("_most").over(before), F.lit(0.0))),
    )
    everything = W.partitionBy()
    left = F.col("_total") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_most"))).over(everything), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(everything)
    target = F.when(F.col("_full"), F.col("_most")).otherwise(F.col("weight") * (left / open_weight))
    return ranked.select("source", "source_size", "n_docs", "weight", target.alias("target"))


def mix_plan(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, tie.

    taken counts words with repeats: whole epochs plus the part of the last one
    that falls before the budget. Null texts have size 0 and nothing is taken
    of them; a null source is a source of its own; a null doc_id is keyed as
    the empty string; rows that repeat a doc_id stand next to each other, are
    told apart by size and by the hash of their text, and each count; an empty
    table gives an empty plan. Columns besides doc_id, text and source are
    ignored.
    """
    sized = docs.select(
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("_key"),
        F.xxhash64("text").alias("tie"),
    )
    sized = materialize(sized, "mix-sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = source_targets(totals, weights, share, cap).withColumn(
        "_digits", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_docs") / LEAF) / 4)).cast("int")
    )
    placed = (
        sized.alias("a")
        .join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
        .select("a.*", "b.source_size", "b.target", F.expr("substring(a._key, 1, b._digits)").alias("_leaf"))
    )
    leaves = placed.groupBy("source", "_leaf").agg(F.sum("size").alias("_leaf_size"))
    up_to = W.partitionBy("source").orderBy("_leaf").rowsBetween(W.unboundedPreceding, -1)
    leaves = leaves.select(
        F.col("source").alias("_s"),
        F.col("_leaf").alias("_l"),
        F.coalesce(F.sum("_leaf_size").over(up_to), F.lit(0)).alias("_offset"),
    )
    placed = placed.join(leaves, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_leaf") == F.col("_l")))
    inside = W.partitionBy("source", "_leaf").orderBy("_key", "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    begin = F.col("_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor("target") - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.least(F.greatest(rest - begin, F.lit(0)), F.col("size"))
    return placed.select(
        "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "tie"
    )


def apply_mix(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mixed documents: a row for each epoch of a document, the last one cut after its last taken word.

    Columns are those of docs; n_chars, if there, follows a cut text. Rows that
    agree in doc_id, source and text are planned as equals, so pairing them by
    their position among equals loses none; where no rows agree, texts are
    shuffled once. Nulls are values like others.
    """
    key, source, tie, size, count, words_ = (free_name(docs, n) for n in ("_pid", "_psrc", "_ptie", "_size", "_taken", "_words"))
    mine = F.xxhash64("text")
    right = plan.select(
        F.col("doc_id").alias(key), F.col("source").alias(source), F.col("tie").alias(tie), F.col("size").alias(size), F.col("taken").alias(count)
    ).where(F.col(count) > 0)
    right = materialize(right, "mix-taken")
    on = F.col("doc_id").eqNullSafe(F.col(key)) & F.col("source").eqNullSafe(F.col(source)) & (mine == F.col(tie))
    if plan.groupBy("doc_id", "source", "tie").count().where("count > 1").limit(1).count():
        nth, other = free_name(docs, "_nth"), free_name(docs, "_pnth")
        left = docs.withColumn(nth, F.row_number().over(W.partitionBy("doc_id", "source", mine).orderBy(F.lit(1))))
        right = right.withColumn(other, F.row_number().over(W.partitionBy(key, source, tie).orderBy(F.desc(count))))
        joined = left.join(right, on & (F.col(nth) == F.col(other)))
    else:
        joined = docs.join(right, on)
    parts = F.transform(
        F.sequence(F.lit(1), F.ceil(F.col(count) / F.col(size)).cast("int")),
        lambda i: F.least(F.col(size), F.col(count) - (i - 1) * F.col(size)),
    )
    rows = joined.withColumn(words_, F.explode(parts))
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), F.col(words_).cast("int")), "")
    text = F.when(F.col(words_) < F.col(size), cut).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn(
            "n_chars", F.when(F.col(words_) < F.col(size), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        )
    return rows.select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
             2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM t),
f AS (SELECT *, most * sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
        <= w * (total - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS capped FROM r),
g AS (SELECT source, source_size, CASE WHEN capped THEN most ELSE
        w * ((total - coalesce(sum(CASE WHEN capped THEN most END) OVER (), 0)) / (sum(CASE WHEN NOT capped THEN w END) OVER ())::DOUBLE) END AS target FROM f),
p AS (SELECT d.doc_id, d.size, g.source_size, g.target,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_at
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(greatest(floor(target)::BIGINT - epochs * source_size - begin_at, 0), size))::BIGINT AS taken
FROM e
"""
