"""How a vocabulary covers strings: words and tokens by frequency, changes between corpora, conventions of encoding."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vocab import WORD, words

#: How a status string may be written before it is encoded.
CONVENTIONS: Mapping[str, Callable[[Column], Column]] = {
    "raw": lambda x: x,
    "leading space only": lambda x: F.concat(F.lit(" "), x),
    "lowercase only": F.lower,
    "normalized": lambda x: F.concat(F.lit(" "), F.lower(x)),
}


def moves(before: DataFrame, after: DataFrame, frequent: int) -> DataFrame:
    """word, before, after, kind of words whose count crosses from none, or the line, either way; both have (word, n)."""
    b, a = F.coalesce("before", F.lit(0)), F.coalesce("after", F.lit(0))
    rows = before.select("word", F.col("n").alias("before")).join(after.select("word", F.col("n").alias("after")), "word", "full").select("word", b.alias("before"), a.alias("after"))
    x, y = F.col("before"), F.col("after")
    kind = (
        F.when((x == 0) & (y >= frequent), "absent -> frequent").when((x == 0) & (y > 0), "absent -> present")
        .when((x < frequent) & (y >= frequent), "rare -> frequent").when((y == 0) & (x > 0), "present -> absent")
        .when((y < frequent) & (x >= frequent), "frequent -> rare")
    )
    return rows.withColumn("kind", kind).where("kind is not null")


def check_terms(terms: DataFrame, book: DataFrame, before: DataFrame, after: DataFrame, expected: bool, frequent: int) -> DataFrame:
    """term, in_book, before, after, moved, verdict of each of terms(term) against counts (word, n) and a book's words (word)."""
    named = terms.select(F.col("term").alias("word")).join(before.select("word", F.col("n").alias("before")), "word", "left").join(after.select("word", F.col("n").alias("after")), "word", "left")
    named = named.join(book.select("word", F.lit(True).alias("in_book")).distinct(), "word", "left").fillna(0, ["before", "after"]).fillna(False, ["in_book"])
    b, a = F.col("before"), F.col("after")
    moved = ((b == 0) & (a > 0)) | ((b < frequent) & (a >= frequent))
    if expected:
        corpus = F.when(a > b, "confirmed").otherwise("no rise")
        side = F.when(~F.col("in_book"), "not in the book").when(moved, "moved").when(b >= frequent, "frequent before").otherwise("under the line")
        verdict = F.concat_ws("; ", corpus, side)
    else:
        verdict = F.when(moved, "refuted").otherwise("confirmed")
    return named.select(F.col("word").alias("term"), "in_book", "before", "after", moved.alias("moved"), verdict.alias("verdict"))


def word_frequent(strings: DataFrame, counts: DataFrame, frequent: int, pattern: str = WORD) -> DataFrame:
    """strings(text) with covered: whether all its words have at least so many counts; one without words is covered."""
    distinct = strings.select("text").distinct()
    spread = distinct.select("text", F.explode_outer(F.array_distinct(words(F.col("text"), pattern))).alias("word")).join(counts.select("word", "n"), "word", "left")
    told = spread.groupBy("text").agg(F.coalesce(F.min(F.when(F.col("word").isNotNull(), F.coalesce("n", F.lit(0)))) >= frequent, F.lit(True)).alias("covered"))
    return strings.join(told, "text", "left")


def partition(strings: DataFrame, counts: DataFrame, frequent: int) -> DataFrame:
    """text (lower case), side: high if every word is frequent, else low."""
    rows = word_frequent(strings, counts, frequent)
    return rows.select(F.lower("text").alias("text"), F.when(F.col("covered"), "high").otherwise("low").alias("side")).distinct()


def side_counts(events: DataFrame, sides: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, events, unmapped, and per side events and types, of events(type) and sides(text, side); a missing or unknown type is unmapped."""
    rows = events.join(sides, F.lower(F.col("type")) == F.col("text"), "left")
    of = lambda s: F.col("side") == s
    return rows.groupBy(*by).agg(
        F.count("*").alias("events"), F.count_if(F.col("side").isNull()).alias("unmapped"), F.count_if(of("high")).alias("high"), F.count_if(of("low")).alias("low"),
        F.count_distinct(F.when(of("high"), F.col("type"))).alias("high_types"), F.count_distinct(F.when(of("low"), F.col("type"))).alias("low_types"),
    )


def token_sides(strings: DataFrame, counts: DataFrame, frequent: int) -> DataFrame:
    """key, covered (every token is frequent), first_only (only the first is rare) of strings(key, ids) and counts(token, n)."""
    spread = strings.select("key", F.posexplode_outer("ids").alias("at", "token")).join(counts, "token", "left")
    rare = F.col("token").isNotNull() & (F.coalesce("n", F.lit(0)) < frequent)
    return spread.groupBy("key").agg((F.count_if(rare) == 0).alias("covered"), ((F.count_if(rare) == 1) & (F.min(F.when(rare, F.col("at"))) == 0)).alias("first_only")).fillna(False, ["first_only"])


def coverage_class(token: Column, word: Column) -> Column:
    return F.when(token & word, "both").when(token, "tokens only").when(word, "words only").otherwise("neither")


def convention_coverage(strings: DataFrame, encode: Callable[[DataFrame], DataFrame], counts: DataFrame, frequent: int) -> DataFrame:
    """convention, strings, covered, tokens, chars, bytes of strings(text) under each convention; encode adds ids to rows with text."""
    written = F.explode(F.array(*[F.struct(F.lit(n).alias("convention"), f(F.col("raw")).alias("text")) for n, f in CONVENTIONS.items()]))
    rows = strings.select(F.col("text").alias("raw")).distinct().select("raw", written.alias("x")).select("raw", "x.convention", "x.text")
    coded = encode(rows).withColumn("key", F.struct("convention", "raw"))
    sides = token_sides(coded.select("key", "ids"), counts, frequent)
    both = coded.join(sides, "key")
    return both.groupBy("convention").agg(
        F.count("*").alias("strings"), F.count_if("covered").alias("covered"), F.sum(F.size("ids")).alias("tokens"), F.sum(F.char_length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes")
    )


def compression(coded: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, bytes, tokens, bytes_per_token of rows (text, ids)."""
    out = coded.groupBy(*by).agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.size("ids")).alias("tokens"))
    return out.withColumn("bytes_per_token", F.try_divide("bytes", "tokens"))


def word_forms(strings: DataFrame, counts: DataFrame) -> DataFrame:
    """key, at, form, known, n: the alphabetic chunks of strings(key, text) with their counts in lower case, 0 if unknown."""
    rows = strings.select("key", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("at", "form"))
    found = rows.join(counts.select(F.col("word").alias("_w"), "n"), F.lower("form") == F.col("_w"), "left")
    return found.select("key", "at", "form", F.col("_w").isNotNull().alias("known"), F.coalesce("n", F.lit(0)).alias("n"))


def site_membership(book: DataFrame, messages: DataFrame) -> DataFrame:
    """text, sites (sorted) of a book's strings(text) by the messages(site, message) that are the same in lower case.

    Strings that agree in lower case, or messages that the book lacks, are an error.
    """
    keyed = book.select("text", F.lower("text").alias("_k"))
    if twice := keyed.groupBy("_k").count().where("count > 1").limit(3).collect():
        raise ValueError(f"strings agree in lower case: {[r['_k'] for r in twice]}")
    said = messages.select("site", F.lower("message").alias("_k")).distinct()
    if unknown := said.join(keyed, "_k", "left_anti").limit(3).collect():
        raise ValueError(f"messages aren't in the book: {[r['_k'] for r in unknown]}")
    joined = keyed.join(said, "_k", "left")
    return joined.groupBy("text").agg(F.array_sort(F.collect_set("site")).alias("sites"))


def site_groups(membership: DataFrame, n_sites: int) -> DataFrame:
    """kind, n: strings of all sites together, only one's, shared by all."""
    sites = F.col("sites")
    kind = F.when(F.size(sites) == n_sites, "shared by all").when(F.size(sites) == 1, F.concat(F.lit("only "), sites[0].cast("string"))).otherwise("some")
    return membership.where(F.size(sites) > 0).withColumn("kind", F.explode(F.array(F.lit("pooled"), kind))).groupBy("kind").agg(F.count("*").alias("n"))


def casing(book: DataFrame) -> DataFrame:
    """lower, text: how the provider writes each string."""
    return book.select(F.lower("text").alias("lower"), "text").distinct()
