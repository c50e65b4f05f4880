"""Documents out of pages: report days in three templates, single documents, links; archives' narrative tables.

Blocks are found by regular expressions in the JVM; only entities are decoded
in Arrow batches, on the text that was found.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import strip
from .text import unescape_entities

# How the pages mark their blocks, newest template first.
BLOCKS = {
    "modern": (r'(?s)<div class="grid border" id="(en\d+)">(.*?)(?=<div class="grid border" id="en\d+">|\z)', r'(?s)<b>Event Text</b>\s*<div class="border">(.*?)</div>'),
    "midera": (
        r'(?s)<a name="(en\d+)"></a>(.*?)(?=<a name="en\d+"></a>|\z)',
        r"(?s)<p[^>]*>\s*<b[^>]*>Event Text</b>\s*</p>\s*<table[^>]*>\s*<tbody[^>]*>\s*<tr[^>]*>\s*<td[^>]*>(.*?)</td>\s*</tr>\s*</tbody>\s*</table>",
    ),
}
MARKERS = {"modern": r'<div class="grid border"', "midera": r'<a name="en\d+"></a>', "legacy": r"<pre>"}
PRE, HEADING, BOX, NUMBER = r"(?s)<pre>(.*?)</pre>", r"(?m)^\s*EVENT TEXT\s*$", r"(?m)^\+-+\+[ \t]*$", r"(?i)Event Number:\s*(\d+)"
BODY, TITLE = r'(?s)field--name-field-body[^>]*>(.*?)<div class="last-modified', r"(?s)<h1[^>]*>(.*?)</h1>"
DAY_LINK, YEAR_DOCUMENT = r'href="([^"]*/(?:19|20)\d\d/\d{8}en)"', r"/(19|20)\d\d/[a-zA-Z0-9_.-]+$"


def tidy(fragment: Column) -> Column:
    """Line breaks kept, tags gone, blanks to one space, runs of blank lines to one line break, stripped; entities as they are."""
    x = F.regexp_replace(F.regexp_replace(fragment, r"(?i)<br\s*/?\??>", "\n"), r"(?s)<[^>]+>", "")
    return collapse(x)


def collapse(x: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\n\s*\n+", "\n"))


def strip_html(fragment: Column) -> Column:
    """Plain text of a fragment: line breaks kept, tags gone, entities decoded, blanks and blank lines collapsed."""
    x = F.regexp_replace(F.regexp_replace(fragment, r"(?i)<br\s*/?\??>", "\n"), r"(?s)<[^>]+>", "")
    return collapse(unescape_entities(x))


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)


def marked_template(html: Column) -> Column:
    """The first template whose marker the page has, whether or not it reports anything."""
    out = None
    for name, marker in MARKERS.items():
        hit = html.rlike(marker)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unrecognised")


def _boxes(html: Column) -> Column:
    """Events of the plain-text template: at each heading the nearest number before it, and what stands between the next two box lines."""
    pieces = F.split(F.regexp_extract(html, PRE, 1), HEADING)

    def event(i: Column) -> Column:
        before = F.array_join(F.slice(pieces, F.lit(1), i), "")
        after = F.split(F.array_join(F.slice(pieces, i + 1, F.size(pieces)), "\n"), BOX)
        lines = F.transform(F.split(F.get(after, F.lit(1)), "\n"), lambda v: F.rtrim(F.regexp_replace(strip(v), r"^\||\|$", "")))
        number = F.get(F.reverse(F.regexp_extract_all(before, F.lit(NUMBER), F.lit(1))), F.lit(0))
        return F.struct(F.concat(F.lit("en"), number).alias("number"), F.array_join(lines, "\n").alias("part"), F.lit("legacy").alias("era"))

    found = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), event)
    return F.when(F.size(pieces) > 1, F.filter(found, lambda e: e["number"].isNotNull() & e["part"].isNotNull())).otherwise(F.array().cast("array<struct<number:string,part:string,era:string>>"))


def _blocks(html: Column, era: str) -> Column:
    block, text = BLOCKS[era]
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(block), F.lit(1)).alias("number"), F.regexp_extract_all(html, F.lit(block), F.lit(2)).alias("body"))
    parts = F.transform(pairs, lambda p: F.struct(p["number"].alias("number"), F.regexp_extract(p["body"], text, 1).alias("part"), F.lit(era).alias("era")))
    return F.filter(parts, lambda p: tidy(p["part"]) != "")


def report_days(pages: DataFrame) -> DataFrame:
    """doc_id, url, text, template of every event of pages(url, html); of each page the first template that finds any.

    A null page has no events; rows that repeat are read each.
    """
    found = F.lit(None).cast("array<struct<number:string,part:string,era:string>>")
    for some in (_boxes(F.col("html")), _blocks(F.col("html"), "midera"), _blocks(F.col("html"), "modern")):
        found = F.when(F.size(some) > 0, some).otherwise(found)
    rows = pages.where("html is not null").select("url", F.explode(found).alias("e"))
    boxed = F.regexp_replace(F.regexp_replace(strip(unescape_entities(F.col("e.part"))), r"[ \t]+", " "), r"\n\s*\n+", "\n\n")
    rows = rows.select("url", "e.number", "e.era", F.when(F.col("e.era") == "legacy", boxed).otherwise(strip_html(F.col("e.part"))).alias("text"))
    return rows.where("text <> ''").select(
        F.concat_ws("_", last_segment(F.col("url")), "number").alias("doc_id"), F.concat_ws("#", "url", "number").alias("url"), "text", F.col("era").alias("template")
    )


def single_documents(pages: DataFrame) -> DataFrame:
    """doc_id, url, title, text of pages(url, html) that have a body; others give no row."""
    rows = pages.select("url", F.regexp_extract("html", BODY, 1).alias("body"), F.regexp_extract("html", TITLE, 1).alias("head")).where("body <> ''")
    out = rows.select(last_segment(F.col("url")).alias("doc_id"), "url", strip_html(F.col("head")).alias("title"), strip_html(F.col("body")).alias("text"))
    return out.where("text <> ''")


def absolute(href: Column, site: str) -> Column:
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(site), href))


def document_links(html: Column, site: str) -> Column:
    """Distinct links to documents under a year, absolute and sorted: no index pages, no PDF files."""
    hrefs = F.regexp_extract_all(html, F.lit(r'href="([^"]+)"'), F.lit(1))
    kept = F.filter(hrefs, lambda h: ~F.contains(h, F.lit("index")) & ~F.endswith(F.lower(h), F.lit(".pdf")) & h.rlike(YEAR_DOCUMENT))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda h: absolute(h, site))))


def day_links(html: Column, site: str) -> Column:
    """Distinct links to report days, absolute, in the page's order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(DAY_LINK), F.lit(1)), lambda h: absolute(h, site)))


def unquote(x: Column) -> Column:
    """A field without the quotes that a reader has left around it, and doubled ones inside made single."""
    t = strip(x)
    quoted = (F.char_length(t) >= 2) & F.startswith(t, F.lit('"')) & F.endswith(t, F.lit('"'))
    return F.when(quoted, F.replace(F.substring(t, F.lit(2), F.char_length(t) - 2), F.lit('""'), F.lit('"'))).otherwise(t)


def narratives(table: DataFrame, kind: str, report: str, narrative: str) -> DataFrame:
    """doc_id (kind_report) and text of rows with a narrative."""
    text = unquote(F.col(narrative))
    return table.select(F.concat_ws("_", F.lit(kind), strip(F.col(report).cast("string"))).alias("doc_id"), text.alias("text")).where("text <> ''")


def column_profiles(table: DataFrame, columns: Sequence[str], least_chars: float = 80.0, least_distinct: float = 0.5) -> DataFrame:
    """column, filled, mean_chars, distinct_share, tokens, narrative: which columns of a table are told in free text."""
    rows = table.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.nullif(strip(F.col(f"`{c}`").cast("string")), F.lit("")).alias("v")) for c in columns])).alias("x"))
    out = rows.groupBy("x.column").agg(
        F.count("x.v").alias("filled"), F.avg(F.char_length("x.v")).alias("mean_chars"), F.try_divide(F.count_distinct("x.v"), F.count("x.v")).alias("distinct_share"),
        F.coalesce(F.sum(F.regexp_count("x.v", F.lit(r"\S+"))), F.lit(0)).alias("tokens"),
    )
    return out.withColumn("narrative", F.coalesce((F.col("mean_chars") >= least_chars) & (F.col("distinct_share") >= least_distinct), F.lit(False)))


def event_key(doc_id: Column) -> tuple[Column, Column]:
    """Day and event of an id like 20030425en_en39780; nulls for others."""
    pattern = r"^(\d{8})en_(en\d+)$"
    part = lambda n: F.nullif(F.regexp_extract(doc_id, pattern, n), F.lit(""))
    return part(1), part(2)


def latest_revisions(docs: DataFrame, source: str, order: str) -> DataFrame:
    """docs(doc_id, source): of one source's events the latest day's row, of a day's rows the last by order; all other rows stay."""
    day, event = event_key(F.col("doc_id"))
    mine = F.col("source") == source
    rows = docs.withColumn("_d", F.when(mine, day)).withColumn("_e", F.when(mine, event))
    best = rows.where("_e is not null").groupBy("_e").agg(F.max_by(F.struct(*docs.columns), F.struct("_d", order)).alias("r")).select("r.*")
    return rows.where("_e is null").select(*docs.columns).unionByName(best)
