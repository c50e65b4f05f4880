"""URL filters: a fixed list of host/path rules, then mined association rules.

FP-growth (the JVM's) mines token combinations of labelled URLs. Rules that
conclude the bad label with enough support and confidence, and that no more
general rule makes superfluous, are matched to all URLs by an inverted index
on each rule's rarest token. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: The list in the SQL, left as it stood when RULES was set to the contract's words; it still has those of net and example.net the other way round.
SQL_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("allow", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
BAD = "label=bad"


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and for an URL without '://'."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    fits = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    return (
        F.when(fits, _ascii_lower(F.regexp_extract(url, pattern, 1))).otherwise(""),
        F.when(fits, F.regexp_extract(url, pattern, 2)).otherwise(""),
    )


def listed(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. A rule's host fits itself and subdomains."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: host labels, hyphenated parts of labels, path segments without digits, query keys."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = F.flatten(F.transform(F.filter(labels, lambda x: F.contains(x, F.lit("-"))), lambda x: F.split(x, "-")))
    segments = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.split(x, "=")[0])
    tag = lambda mark, a: F.transform(a, lambda x: F.concat(F.lit(mark), x))
    return F.array_distinct(F.concat(tag("h:", labels), tag("w:", parts), tag("p:", segments), tag("q:", keys)))


def mine_rules(
    labelled: DataFrame, min_support: float = 0.0002, min_confidence: float = 0.6, min_lift: float = 1.5, min_count: int = 10
) -> DataFrame:
    """items (sorted array), confidence, support of rules items -> bad, from rows (url, bad boolean).

    A rule's support is at least min_support of the labelled rows and min_count
    rows; min_support bounds what FP-growth holds on the driver, as at most a
    few tokens per row can each be in that share of the rows. A rule's
    confidence is at least min_confidence and min_lift times the share of bad
    rows. A rule is kept only if no rule on a part of its items is as
    confident. Rows with a null label or url are left out; rows that repeat
    count each. No labelled rows, or none bad, give no rules.
    """
    host, path = split_url(F.col("url"))
    rows = labelled.where("bad is not null and url is not null").select(
        F.concat(
            url_tokens(host, path, F.col("url")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))
        ).alias("items")
    )
    least = min(1.0, max(min_support, min_count / max(1, rows.count())))
    model = FPGrowth(minSupport=least, minConfidence=min_confidence).fit(rows)
    found = model.associationRules.where((F.col("consequent")[0] == BAD) & (F.col("lift") >= min_lift))
    return without_superfluous(materialize(found.select(F.array_sort("antecedent").alias("items"), "confidence", "support"), "url-rules"))


def filed(rules: DataFrame, frequency: DataFrame) -> DataFrame:
    """Rules with token: that one of their items which has the least n in frequency(token, n), ties by code point."""
    spread = rules.withColumn("token", F.explode("items")).join(frequency, "token")
    return spread.groupBy(*rules.columns).agg(F.min_by("token", F.struct("n", "token")).alias("token"))


def without_superfluous(rules: DataFrame) -> DataFrame:
    """Rules of which no part of the items is a rule as confident.

    A rule is looked up under its item that the fewest rules have, so rules
    meet where a rare item is shared, not on every common one.
    """
    often = rules.select(F.explode("items").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    narrow = filed(rules.select("items", "confidence"), often).select(F.col("items").alias("_part"), F.col("confidence").alias("_c"), "token")
    wide = rules.select("items", "confidence", F.explode("items").alias("token"))
    inside = (F.size("_part") < F.size("items")) & F.forall("_part", lambda x: F.array_contains("items", x)) & (F.col("_c") >= F.col("confidence"))
    return rules.join(wide.join(narrow, "token").where(inside).select("items").distinct(), "items", "left_anti")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, confidence (of the best fitting rule) for the distinct urls that some rule fits.

    The index holds a rule under one of its tokens, the one that the fewest
    distinct URLs have, so common tokens don't multiply rows.
    """
    host, path = split_url(F.col("url"))
    tokens = urls.select("url").where("url is not null").distinct().withColumn("tokens", url_tokens(host, path, F.col("url")))
    spread = tokens.select("url", "tokens", F.explode("tokens").alias("token"))
    wanted = rules.select(F.explode("items").alias("token")).distinct()
    frequency = spread.join(wanted, "token").groupBy("token").agg(F.count("*").alias("n"))
    index = filed(rules.select("items", "confidence"), frequency)
    return (
        spread.join(index, "token")
        .where(F.forall("items", lambda x: F.array_contains("tokens", x)))
        .groupBy("url")
        .agg(F.max("confidence").alias("confidence"))
    )


def filter_urls(pages: DataFrame, labelled: DataFrame, **mining) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence for each row of pages(page_id, url).

    Null URLs and URLs without '://' have empty host and path, fit no rule and
    are allowed. Rows that repeat are judged each; other columns are ignored.
    """
    host, path = split_url(F.col("url"))
    rules = mine_rules(labelled, **mining)
    mined = match_rules(pages, rules).select(F.col("url").alias("_u"), "confidence")
    rows = pages.select("page_id", "url").join(mined, F.col("url") == F.col("_u"), "left")
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), "confidence")
    rows = rows.withColumn("_l", listed(F.col("host"), F.col("path")))
    mined_verdict = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return rows.select(
        "page_id", "host", "path", F.col("_l.rule").alias("rule"),
        F.coalesce(F.col("_l.verdict"), mined_verdict).alias("verdict"), "confidence",
    )


def listed_urls(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, list_verdict for each row of pages(page_id, url): what the fixed list says, null where it says nothing."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("_l", listed(F.col("host"), F.col("path")))
    return rows.select("page_id", "host", "path", F.col("_l.rule").alias("rule"), F.col("_l.verdict").alias("list_verdict"))


def list_oracle() -> str:
    """SQL of listed_urls(), the longest fitting rule by sorting."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in SQL_RULES)
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN split_part(split_part(split_part(substr(url, instr(url, '://') + 3), '/', 1), '?', 1), '#', 1) ELSE '' END AS raw,
  CASE WHEN contains(url, '://') THEN split_part(split_part(substr(url, instr(url, '://') + 3), '?', 1), '#', 1) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(raw) + 1) AS path FROM u),
r(verdict, rhost, rpath) AS (VALUES {rules}),
m AS (SELECT h.*, rhost || rpath AS rule, verdict FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
      QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) = 1)
SELECT h.page_id, h.host, h.path, m.rule, m.verdict AS list_verdict FROM h LEFT JOIN m USING (page_id)
"""
