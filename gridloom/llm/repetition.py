"""Quality rules on repetition inside a text, by suffix arrays over words.

A block of documents is sorted at once by prefix doubling: a suffix's rank
after step k orders it by its first BASE * 2**k words, and only suffixes that
share their rank are sorted again. Ranks start from (document, BASE words), so
no suffix equals one of another document. Suffixes that begin like no other are
in no repeat of BASE words and stay out, but for those that follow a repeated
start. Descending through the kept ranks gives the longest common prefix (LCP)
of neighbours.

An LCP interval is a run of neighbouring suffixes that share a prefix which no
neighbour outside has; its suffixes begin all occurrences of one repeat, and
the repeat can't be extended to the right. The value of the deepest interval
that holds a suffix is the larger LCP with its two neighbours: the longest
repeat that begins there. An occurrence of it is maximal if no repeat that
begins one word earlier covers it, that is, if it can't be extended to the left
either. The union of the maximal occurrences of at least min_words words is
covered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import Words, add_column, byte_set, free_name, gram_hashes, mix, utf8

BASE = 3
SYMBOLS = b"#*$%&|<>"
MEASURES = (
    "n_words:long, word_chars:long, n_symbols:long, n_dup_lines:long, n_repeat_words:long, covered_words:long, "
    "covered_chars:long, longest_repeat:long, n_maximal:long, spans:array<struct<start:long,end:long>>"
)
NUMBERS = [f.partition(":")[0] for f in MEASURES.split(", ")[:-1]]


def repeat_lengths(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word position, the value of its suffix's deepest LCP interval: the most words from there on that stand elsewhere in the document too; 0 if under BASE."""
    n = len(hashes)
    longest = np.zeros(n, np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    stop = np.repeat(first[1:], np.diff(first))
    grams = gram_hashes(hashes, BASE)
    valid = np.flatnonzero(stop[: len(grams)] - np.arange(len(grams)) >= BASE)
    keys = mix(grams[valid] + doc[valid].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return longest
    maybe = np.zeros(1 << 20, bool)
    maybe[twice >> np.uint64(44)] = True
    some = valid[maybe[keys >> np.uint64(44)]]
    then = some + BASE
    order = np.union1d(some, then[then < stop[some]])
    columns = [np.where(order + k < stop[order], hashes[np.minimum(order + k, n - 1)], 0) for k in range(BASE - 1, -1, -1)]
    sort = np.lexsort([*columns, doc[order]])
    order = order[sort]
    fresh = np.ones(len(order), bool)
    fresh[1:] = False
    for column in [*columns, doc[np.sort(order)]]:
        column = column[sort]
        fresh[1:] |= column[1:] != column[:-1]
    rank = np.arange(n, 2 * n)
    rank[order] = _group_starts(fresh)
    ranks, at, step = [rank], np.arange(len(order)), BASE
    while True:
        rank = ranks[-1]
        same = np.zeros(len(at) + 1, bool)
        same[1:-1] = (rank[order[at[1:]]] == rank[order[at[:-1]]]) & (np.diff(at) == 1)
        at = at[same[1:] | same[:-1]]
        if not len(at):
            break
        who = order[at]
        after = who + step
        inside = after < stop[who]
        follow = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        keys = rank[who] * (2 * n + 1) + follow
        sort = np.argsort(keys)
        order[at] = who[sort]
        new = rank.copy()
        keys = keys[sort]
        new[order[at]] = at[_group_starts(np.append(True, keys[1:] != keys[:-1]))]
        ranks.append(new)
        step *= 2
    a, b = order[:-1], order[1:]
    lcp = np.zeros(len(order) - 1, np.int64)
    live = np.flatnonzero(ranks[0][a] == ranks[0][b])
    a, b, got = a[live], b[live], np.zeros(len(live), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        got[_equal(ranks[level], a + got, b + got, stop[a], stop[b])] += BASE << level
    for _ in range(BASE - 1):
        got[_equal(hashes, a + got, b + got, stop[a], stop[b])] += 1
    lcp[live] = got
    longest[order[:-1]] = lcp
    longest[order[1:]] = np.maximum(longest[order[1:]], lcp)
    return longest


def _equal(values, x, y, x_stop, y_stop) -> np.ndarray:
    top = len(values) - 1
    return (x < x_stop) & (y < y_stop) & (values[np.minimum(x, top)] == values[np.minimum(y, top)])


def _group_starts(fresh: np.ndarray) -> np.ndarray:
    """For each place, the nearest one at or before it that begins a group."""
    return np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))


def maximal(lengths: np.ndarray) -> np.ndarray:
    """Whether the longest repeat from each position on can't be extended to the left; a document's last positions have 0, so none reaches over from the one before."""
    before = np.concatenate([[0], lengths[:-1]])
    return (lengths > 0) & (before != lengths + 1)


def covered(lengths: np.ndarray, least: int) -> np.ndarray:
    """Words inside a maximal repeat of at least least words."""
    at = np.flatnonzero((lengths >= least) & maximal(lengths))
    change = np.zeros(len(lengths) + 1, np.int64)
    np.add.at(change, at, 1)
    np.subtract.at(change, at + lengths[at], 1)
    return np.cumsum(change[:-1]) > 0


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _dup_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def add_measures(docs: DataFrame, column: str, min_words: int = 8) -> DataFrame:
    """All columns of docs, and column: a struct of MEASURES."""

    def measure(batch: pa.RecordBatch) -> pa.Array:
        data, offsets = utf8(batch.column("text"))
        words = Words(data, offsets)
        first = words.first
        lead = (data & 0xC0) != 0x80
        chars = np.zeros(len(data) + 1, np.int64)
        np.cumsum(lead, out=chars[1:])
        word_len = chars[words.ends] - chars[words.starts]
        lengths = repeat_lengths(words.hashes(), first)
        inside = covered(lengths, min_words)
        raw = data.tobytes()
        top = np.zeros(len(first) - 1, np.int64)
        has = np.flatnonzero(np.diff(first))
        if len(has):
            top[has] = np.maximum.reduceat(lengths, first[:-1][has])
        spans, counts = [], np.zeros(len(first), np.int64)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        begin = inside.copy()
        finish = inside.copy()
        if len(inside):
            joined = inside[1:] & inside[:-1] & (doc[1:] == doc[:-1])
            begin[1:] &= ~joined
            finish[:-1] &= ~joined
        at = np.flatnonzero(begin)
        origin = chars[offsets[:-1]]
        spans = pa.StructArray.from_arrays(
            [
                pa.array(chars[words.starts[at]] - origin[doc[at]], pa.int64()),
                pa.array(chars[words.ends[np.flatnonzero(finish)]] - origin[doc[at]], pa.int64()),
            ],
            ["start", "end"],
        )
        np.cumsum(np.bincount(doc[at], minlength=len(first) - 1), out=counts[1:])
        cols = [
            np.diff(first), _sums(word_len, first), _sums(byte_set(SYMBOLS)[data], offsets),
            np.array([_dup_lines(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]),
            _sums(covered(lengths, 3), first), _sums(inside, first), _sums(word_len * inside, first), top,
            _sums((lengths >= min_words) & maximal(lengths), first),
        ]
        lists = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), spans)
        return pa.StructArray.from_arrays([*[pa.array(c, pa.int64()) for c in cols], lists], [f.partition(":")[0] for f in MEASURES.split(", ")])

    return add_column(docs, column, f"struct<{MEASURES}>", measure)


def measure_repeats(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """doc_id and MEASURES for every row of docs(doc_id, text).

    covered_words and covered_chars count words, and code points of words, in
    repeats of at least min_words words; longest_repeat counts the words of the
    longest repeat, 0 if it has under three; n_maximal counts the maximal
    occurrences in the union; spans are its code point ranges. A null text counts
    as empty and has zeros. Repeated rows are measured each; other columns are
    ignored; an empty table gives no rows.
    """
    return add_measures(docs.select("doc_id", "text"), "_m", min_words).select("doc_id", "_m.*")


def judge_repeats(
    measured: DataFrame, max_covered: float = 0.3, max_repeat: int = 100, prefix: str = "", verdict: str = "kept"
) -> DataFrame:
    """Adds base_failed and the verdict: kept unless base_failed, over max_covered of the words' characters repeat, or one repeat is longer than max_repeat words."""
    words, repeated, chars, covered_, longest = (
        F.col(prefix + c) for c in ("n_words", "n_repeat_words", "word_chars", "covered_chars", "longest_repeat")
    )
    base = (words < 50) | (100 * repeated > 50 * words)
    kept = ~base & (covered_ <= max_covered * chars) & (longest <= max_repeat)
    return measured.withColumn(prefix + "base_failed", base).withColumn(verdict, kept)


def drop_repetitive(docs: DataFrame, min_words: int = 8, **limits) -> DataFrame:
    """The rows of docs that judge_repeats keeps, with all their columns."""
    name, kept = free_name(docs, "_m"), free_name(docs, "_kept")
    measured = add_measures(docs, name, min_words)
    judged = judge_repeats(measured.select("*", *[F.col(f"{name}.{c}").alias(f"{name}_{c}") for c in NUMBERS]), prefix=f"{name}_", verdict=kept, **limits)
    return judged.where(F.col(kept)).select(*docs.columns)


#: Repeats by joining equal three-word windows of a text: pairs of occurrences at one distance make runs, and a run of r windows is a repeat of r + 2 words.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
g AS (SELECT doc_id, i, md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM x),
r AS (SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
p AS (SELECT a.doc_id, a.i, b.i - a.i AS gap FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.g = b.g AND a.i < b.i),
k AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, gap ORDER BY i) AS island FROM p),
s AS (SELECT doc_id, gap, min(i) AS i, count(*) + 2 AS n FROM k GROUP BY doc_id, gap, island),
c3 AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS at FROM r),
c8 AS (SELECT DISTINCT doc_id, unnest(list_concat(range(i, i + n), range(i + gap, i + gap + n))) AS at FROM s WHERE n >= 8),
m AS (SELECT doc_id, max(n) AS longest FROM s GROUP BY 1),
n3 AS (SELECT doc_id, count(*) AS n FROM c3 GROUP BY 1),
n8 AS (SELECT c8.doc_id, count(*) AS n, sum(length(w[c8.at])) AS chars FROM c8 JOIN d USING (doc_id) GROUP BY 1),
e AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  len(list_filter(string_split(t, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')))::BIGINT - len(list_distinct(list_filter(string_split(t, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]'))))::BIGINT AS n_dup_lines,
  coalesce(n3.n, 0)::BIGINT AS n_repeat_words, coalesce(n8.n, 0)::BIGINT AS covered_words, coalesce(n8.chars, 0)::BIGINT AS covered_chars, coalesce(m.longest, 0)::BIGINT AS longest_repeat
  FROM d LEFT JOIN n3 USING (doc_id) LEFT JOIN n8 USING (doc_id) LEFT JOIN m USING (doc_id))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND covered_chars <= 0.3 * word_chars AND longest_repeat <= 100 AS kept FROM e
"""
