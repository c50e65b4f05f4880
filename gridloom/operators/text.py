"""The document pipeline: clean, filter, mask, deduplicate, split; HTML and paragraphs."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import BLANK, alphabetic_ratio, hash_position, once, repeated_line_ratio, split_by_fractions, strip

# What is markup and what is masked, by version, and the marks that stand for it.
TAGS = {
    "v0": r"<[^>]+>",
    "v1": r"(?s)<!--.*?-->|</?[A-Za-z][A-Za-z0-9:._-]*(?:\s[^<>]*)?/?>",
}
TAG = TAGS["v1"]
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONES = {
    "v0": r"(?<!\d)(?:\+?\d[\d\s().-]{7,}\d)(?!\d)",
    "v1": r"(?<![\w+])(?:\+\d{1,3}[ .\-]?\d{2,5}(?:[ .\-]?\d{2,6}){1,3}|\(0?\d{2,5}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}"
    r"|0\d{1,4}[ .\-]\d{3,4}[ .\-]\d{3,4}|\d{3}[ .\-]\d{3}[ .\-]\d{4})(?!\w)",
}
DIGITS = r"(?<!\d)\d{6,}(?!\d)"
MARKS = {"email": "<EMAIL>", "phone": "<PHONE>", "digits": "<NUMBER>"}


def remove_tags(x: Column, version: str = "v1") -> Column:
    return F.regexp_replace(x, TAGS[version], " ")


def remove_controls(x: Column) -> Column:
    return F.regexp_replace(x, r"[\p{C}&&[^\n\t]]", "")


def normalize_blanks(x: Column) -> Column:
    """Runs of blanks to one space, runs of blank lines to one, stripped."""
    # single spaces are no match, so most words are passed over
    return strip(F.regexp_replace(F.regexp_replace(x, r" [ \t]+|\t[ \t]*", " "), r"\n[ \t]*(?:\n[ \t]*)+", "\n\n"))


def evaluated(df: DataFrame, **columns: Column) -> DataFrame:
    """df with new columns that later filters and projections read instead of making them again.

    A filter on a projected expression is moved below the projection and
    evaluates it a second time; rows of a generator are finished.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a small table dealt to all cores by a key; a table of a whole read split per core stays as it is.

    A small file has fewer row groups than there are cores, and work on long
    texts would run on few of them. What is shuffled is bounded by a split a core.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, key) if size < cores * (128 << 20) else df


def _per_text(f) -> Callable[[Column], Column]:
    @F.pandas_udf(T.StringType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(f, na_action="ignore")

    return run


def unescape_entities(x: Column) -> Column:
    return _per_text(html.unescape)(x)


def normalize_unicode(x: Column, form: str = "NFC") -> Column:
    return _per_text(lambda v: unicodedata.normalize(form, v))(x)


def clean(x: Column, boilerplate: Sequence[str] = (), form: str | None = "NFC", entities: bool = True) -> Column:
    """Boilerplate, entities, tags, Unicode form, control characters, blanks, in this order."""
    for pattern in boilerplate:
        x = F.regexp_replace(x, pattern, "")
    x = unescape_entities(x) if entities else x
    x = remove_tags(x)
    x = normalize_unicode(x, form) if form else x
    return normalize_blanks(remove_controls(x))


def boilerplate_counts(x: Column, rules: Mapping[str, str]) -> dict[str, Column]:
    return {name: F.regexp_count(x, F.lit(pattern)) for name, pattern in rules.items()}


def filter_reason(x: Column, least: int, most: int, letters: float, repeats: float) -> Column:
    """The first rule that fails, else null."""
    return once(
        x,
        lambda t: F.when(F.char_length(t) < least, "min_chars")
        .when(F.char_length(t) > most, "max_chars")
        .when(alphabetic_ratio(t) < letters, "alpha_ratio")
        .when(repeated_line_ratio(t) > repeats, "repeated_lines"),
    )


def document_hash(x: Column) -> Column:
    return F.sha2(F.lower(strip(x)).cast("binary"), 256)


def exact_dedup(df: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each normalised text in the given order."""
    # min_by aggregates before the shuffle, so a text with a third of all rows sends a row per task
    rest = [c for c in df.columns]
    keyed = df.withColumn("_hash", document_hash(F.col("text")))
    return keyed.groupBy("_hash").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select("_r.*")


def keyed_dedup(df: DataFrame, key: Column, version: list[Column]) -> DataFrame:
    """The greatest version of each key; rows with a null key all stay."""
    rest = df.columns
    keyed = df.withColumn("_key", key).withColumn("_v", F.struct(*version))
    latest = keyed.where("_key is not null").groupBy("_key").agg(F.max_by(F.struct(*rest), "_v").alias("_r")).select("_r.*")
    return latest.unionByName(keyed.where("_key is null").select(*rest))


def mask_pii(df: DataFrame, column: str = "text", digits: bool = False, phone: str = "v0") -> DataFrame:
    """Masks e-mails, then phones, then long numbers, each on the text masked so far; adds n_email, n_phone and n_digits.

    What is masked is long enough that the marks put in are the growth of the
    text's own count of marks, so each pattern runs once over each text.
    """
    steps = [("email", EMAIL), ("phone", PHONES[phone])] + ([("digits", DIGITS)] if digits else [])
    for name, pattern in steps:
        mark = MARKS[name]
        marks = lambda x, mark=mark: (F.char_length(x) - F.char_length(F.replace(x, F.lit(mark), F.lit("")))) / len(mark)
        df = evaluated(df, _masked=F.regexp_replace(column, "(?U)" + pattern, F.lit(mark)))
        df = df.withColumn(f"n_{name}", (marks(F.col("_masked")) - marks(F.col(column))).cast("int")).withColumn(column, F.col("_masked")).drop("_masked")
    return df


def assign_split(df: DataFrame, seed: str, fractions: list[tuple[str, float]], per_source: Mapping[str, list[tuple[str, float]]] | None = None) -> DataFrame:
    """Adds split by the hash of seed and text; sources may have fractions of their own."""
    position = hash_position(seed, F.col("text"))
    out = split_by_fractions(position, fractions)
    for source, own in (per_source or {}).items():
        out = F.when(F.col("source") == source, split_by_fractions(position, own)).otherwise(out)
    return df.withColumn("split", out)


def paragraphs(x: Column) -> Column:
    """Blank-line separated paragraphs with single blanks, without empty ones."""
    inner = F.transform(F.split(x, r"\n[ \t]*\n"), lambda p: strip(F.regexp_replace(p, BLANK, " ")))
    return F.filter(inner, lambda p: p != "")


def frequent_paragraphs(df: DataFrame, more_than: int) -> DataFrame:
    """paragraph, n_docs of paragraphs in more than so many documents."""
    rows = df.select(F.explode(F.array_distinct(paragraphs(F.col("text")))).alias("paragraph"))
    return rows.groupBy("paragraph").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > more_than)


def html_text(x: Column) -> Column:
    """Visible text: line breaks kept, scripts, styles and tags gone, blank lines collapsed."""
    x = F.regexp_replace(x, r"(?is)<(script|style)\b[^>]*>.*?</\1>", "")
    x = F.regexp_replace(x, r"(?i)<br\s*/?>", "\n")
    x = F.regexp_replace(F.regexp_replace(x, r"<!--[\s\S]*?-->", ""), r"<[^>]*>", "")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(x, r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def links(x: Column) -> Column:
    """Distinct targets of links, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))))


def template_of(x: Column, markers: Sequence[tuple[str, str]]) -> Column:
    """Name of the first marker found, else 'unrecognised'."""
    out = None
    for name, marker in markers:
        hit = F.contains(x, F.lit(marker))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unrecognised")


def whitespace_tokens(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"\S+"))


def stage_counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n_docs"), F.sum(F.char_length("text")).alias("n_chars_out"), F.sum(whitespace_tokens(F.col("text"))).alias("n_tokens"))


def shards(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Adds shard: size rows each, in order, per key."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("shard", F.floor(n / size).cast("long"))
