"""Queries of the document operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import text as X
from ..operators import vocab as V
from .registry import query

WS = r"[\s\v\x1C-\x1F\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


CLEAN = "regexp_replace(text, '" + X.TAG + "', ' ', 'g')"
CLEAN = f"regexp_replace({CLEAN}, '[\\p{{Cf}}\\p{{Co}}\\x00-\\x08\\x0B-\\x1F\\x7F-\\x9F]', '', 'g')"
CLEAN = f"regexp_replace(regexp_replace({CLEAN}, '[ \\t]+', ' ', 'g'), '\\n[ \\t]*(?:\\n[ \\t]*)+', E'\\n\\n', 'g')"
CLEAN = sql_strip(CLEAN)
LETTERS = "CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '\\p{L}')) / length(text) ELSE 0 END"
LINES = f"list_filter(list_transform(string_split_regex(text, '\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\\x{{2028}}\\x{{2029}}]'), lambda v: {sql_strip('v')}), lambda v: v <> '')"
REPEATS = f"CASE WHEN len({LINES}) > 1 THEN coalesce(list_sum(list_filter(map_values(list_histogram({LINES})), lambda c: c > 1)), 0) / len({LINES}) ELSE 0 END"
REASON = f"CASE WHEN length(text) < 200 THEN 'min_chars' WHEN length(text) > 20000 THEN 'max_chars' WHEN {LETTERS} < 0.7 THEN 'alpha_ratio' WHEN {REPEATS} > 0.3 THEN 'repeated_lines' END"
HASH = f"sha256(lower({sql_strip('text')}))"
POSITION = "(('0x' || substr(sha256('13:' || text), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE)"
SPLIT = f"CASE WHEN {POSITION} < 0.9 THEN 'train' WHEN {POSITION} < 0.9 + 0.05 THEN 'val' ELSE 'test' END"
FRACTIONS = [("train", 0.9), ("val", 0.05), ("test", 0.05)]
DOCS = f"c AS (SELECT doc_id, source, {CLEAN} AS text FROM documents)"
KEPT = f"{DOCS}, k AS (SELECT * FROM c WHERE ({REASON}) IS NULL), u AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY {HASH} ORDER BY doc_id) = 1)"
# leftmost matches of greedy runs need no guards on their sides
PHONE = r"\+?\d[\d\s().-]{7,}\d"
MASK = f"regexp_replace(regexp_replace(text, '{X.EMAIL}', '<EMAIL>', 'g'), '{PHONE}', '<PHONE>', 'g')"


def documents(T):
    return X.spread(T("documents"), "doc_id")


def cleaned(T):
    raw = documents(T).select("doc_id", "source", F.col("text").alias("raw"))
    return X.evaluated(raw, text=X.clean(F.col("raw"), form=None, entities=False)).drop("raw")


def kept(T):
    return cleaned(T).where(X.filter_reason(F.col("text"), 200, 20000, 0.7, 0.3).isNull())


@query("flagship", f"""WITH {KEPT}, m AS (SELECT doc_id, source, {MASK} AS text FROM u), p AS (SELECT *, {SPLIT} AS split FROM m)
SELECT source, split, count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars_out, sum(len(regexp_extract_all(text, '[^\\t\\n\\v\\f\\r ]+')))::BIGINT AS n_tokens FROM p GROUP BY 1, 2""")
def flagship(T):
    """Clean, filter, exact dedup, PII masks, hash split, counts by source and split."""
    docs = X.mask_pii(X.exact_dedup(kept(T), ["doc_id"])).drop("n_email", "n_phone")
    return X.stage_counts(X.assign_split(docs, "13", FRACTIONS), ["source", "split"])


@query("text_clean", f"SELECT doc_id, md5({CLEAN}) AS digest, length({CLEAN}) AS n FROM documents")
def text_clean(T):
    return cleaned(T).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("long").alias("n"))


@query("text_clean_full")
def text_clean_full(T):
    """Pages with entity decoding and a Unicode form; no SQL for either."""
    x = X.clean(F.col("html"), boilerplate=[r"<!-- ad [0-9]+ -->"], form="NFKC")
    return T("pages").select("page_id", F.md5(x.cast("binary")).alias("digest"))


@query("text_filter_reason", f"WITH {DOCS} SELECT coalesce({REASON}, 'kept') AS reason, count(*) AS n FROM c GROUP BY 1")
def text_filter(T):
    reason = F.coalesce(X.filter_reason(F.col("text"), 200, 20000, 0.7, 0.3), F.lit("kept"))
    return cleaned(T).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("text_ratios", f"WITH {DOCS} SELECT doc_id, round({LETTERS}, 9) AS letters, round({REPEATS}, 9) AS repeats FROM c")
def text_ratios(T):
    return cleaned(T).select("doc_id", F.round(S.alphabetic_ratio(F.col("text")), 9).alias("letters"), F.round(S.repeated_line_ratio(F.col("text")), 9).alias("repeats"))


@query("text_exact_dedup", f"WITH {DOCS} SELECT doc_id FROM c QUALIFY row_number() OVER (PARTITION BY {HASH} ORDER BY doc_id) = 1")
def text_dedup(T):
    return X.exact_dedup(cleaned(T), ["doc_id"]).select("doc_id")


@query("text_keyed_dedup", """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def keyed(T):
    o = T("orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return X.keyed_dedup(o, F.col("o_custkey"), [F.col("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@query("text_keyed_groups", "SELECT count(*) AS keys, sum(n - 1)::BIGINT AS superseded FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1)")
def keyed_groups(T):
    n = T("orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 1")
    return n.agg(F.count("*").alias("keys"), F.sum(F.col("n") - 1).alias("superseded"))


@query("text_pii", f"""SELECT doc_id, len(regexp_extract_all(text, '{X.EMAIL}')) AS n_email,
len(regexp_extract_all(regexp_replace(text, '{X.EMAIL}', '<EMAIL>', 'g'), '{PHONE}')) AS n_phone, md5({MASK}) AS digest FROM documents""")
def pii(T):
    m = X.mask_pii(documents(T).select("doc_id", "text"))
    return m.select("doc_id", F.col("n_email").cast("long").alias("n_email"), F.col("n_phone").cast("long").alias("n_phone"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("text_hash_split", f"SELECT doc_id, {SPLIT} AS split FROM documents")
def hash_split(T):
    return X.assign_split(T("documents").select("doc_id", "source", "text"), "13", FRACTIONS).select("doc_id", "split")


@query("text_hash_split_by_source", f"SELECT source, CASE WHEN source = 'src0' THEN CASE WHEN {POSITION} < 0.5 THEN 'train' ELSE 'test' END ELSE {SPLIT} END AS split, count(*) AS n FROM documents GROUP BY 1, 2")
def split_by_source(T):
    d = X.assign_split(T("documents").select("doc_id", "source", "text"), "13", FRACTIONS, {"src0": [("train", 0.5), ("test", 0.5)]})
    return d.groupBy("source", "split").agg(F.count("*").alias("n"))


@query("text_shards", "SELECT source, (n // 16)::BIGINT AS shard, count(*) AS n, min(doc_id) AS first FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents) GROUP BY 1, 2")
def text_shards(T):
    return X.shards(T("documents").select("source", "doc_id"), ["source"], ["doc_id"], 16).groupBy("source", "shard").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


PARAS = f"list_filter(list_transform(string_split_regex(text, '\\n[ \\t]*\\n'), lambda p: {sql_strip(f'''regexp_replace(p, '{WS}+', ' ', 'g')''')}), lambda p: p <> '')"


@query("text_frequent_paragraphs", f"SELECT paragraph, count(*) AS n_docs FROM (SELECT unnest(list_distinct({PARAS.replace('text', 'replace(text, chr(10), chr(10) || chr(10))')})) AS paragraph FROM documents) GROUP BY 1 HAVING count(*) > 3")
def paragraphs(T):
    doubled = T("documents").select(F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return X.frequent_paragraphs(doubled, 3)


@query("text_boilerplate_counts", "SELECT source, sum(len(regexp_extract_all(text, '(?i)licensed? under')))::BIGINT AS license, sum(len(regexp_extract_all(text, '!!')))::BIGINT AS shouts FROM documents GROUP BY 1")
def boilerplate(T):
    c = X.boilerplate_counts(F.col("text"), {"license": r"(?i)licensed? under", "shouts": "!!"})
    return T("documents").groupBy("source").agg(*[F.sum(v).cast("long").alias(k) for k, v in c.items()])


VISIBLE = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>|<style\\b[^>]*>.*?</style>', '', 'g'), '(?i)<br\\s*/?>', E'\\n', 'g'), '<!--[\\s\\S]*?-->', '', 'g')"
VISIBLE = f"regexp_replace(regexp_replace({VISIBLE}, '<[^>]*>', '', 'g'), '[ \\t]+', ' ', 'g')"
VISIBLE = f"regexp_replace(regexp_replace({VISIBLE}, ' ?\\n[ \\n]*', E'\\n', 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"


@query("html_text", f"SELECT page_id, length({VISIBLE}) AS n, md5({VISIBLE}) AS digest FROM pages")
def html_text(T):
    p = X.evaluated(X.spread(T("pages"), "page_id").select("page_id", "html"), x=X.html_text(F.col("html")))
    return p.select("page_id", F.length("x").cast("long").alias("n"), F.md5(F.col("x").cast("binary")).alias("digest"))


@query("html_links", """SELECT page_id, len(l) AS n, array_to_string(l, ' ') AS links FROM (SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1))) AS l FROM pages)""")
def html_links(T):
    p = T("pages").select("page_id", X.links(F.col("html")).alias("l"))
    return p.select("page_id", F.size("l").cast("long").alias("n"), F.array_join("l", " ").alias("links"))


@query("html_template", """SELECT CASE WHEN contains(html, '<article>') THEN 'modern' WHEN contains(html, '<table') THEN 'table' ELSE 'unrecognised' END AS era, count(*) AS n FROM pages GROUP BY 1""")
def template(T):
    era = X.template_of(F.col("html"), [("modern", "<article>"), ("table", "<table")])
    return T("pages").groupBy(era.alias("era")).agg(F.count("*").alias("n"))


@query("robots_rules", """SELECT page_id, NOT (regexp_matches(p, '^/de/') AND NOT regexp_matches(p, '^/de/.*\\.html')) AS allowed
FROM (SELECT page_id, regexp_extract(url, '^[^:]*://[^/]*([^?#]*)', 1) AS p FROM pages)""")
def robots(T):
    from ..sources.readers import robots_allow

    path = F.regexp_extract("url", r"^[^:]*://[^/]*([^?#]*)", 1)
    return T("pages").select("page_id", robots_allow(path, [("disallow", "/de/"), ("allow", "/de/*.html")]).alias("allowed"))


@query("word_counts", """SELECT lang, word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM
(SELECT lang, doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY 1, 2""")
def word_counts(T):
    return V.word_counts(documents(T), ["lang"])


COVER = """w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY 1),
b AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS word FROM benchmark)"""


@query("word_coverage", f"""WITH {COVER} SELECT item_id AS id, count(*) AS words,
CASE WHEN min(coalesce(n, 0)) = 0 THEN 'absent' WHEN min(coalesce(n, 0)) < 20 THEN 'rare' ELSE 'frequent' END AS status FROM b LEFT JOIN w USING (word) GROUP BY 1""")
def coverage(T):
    counts = V.word_counts(T("documents"), [])
    return V.rarest_status(T("benchmark").select(F.col("item_id").alias("id"), "text"), counts, 20)


@query("word_sets", """WITH s AS (SELECT DISTINCT source, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents WHERE source IN ('src0', 'src1'))
SELECT kind, count(*) AS n FROM (SELECT word, CASE WHEN count(*) = 2 THEN 'shared' ELSE min(source) END AS kind FROM s GROUP BY 1) GROUP BY 1""")
def word_sets(T):
    """Set operations of two sources' words: shared, and of one only."""
    d = T("documents").where(F.col("source").isin("src0", "src1"))
    pairs = d.select("source", F.explode(V.words(F.col("text"))).alias("word")).distinct()
    kinds = pairs.groupBy("word").agg(F.when(F.count("*") == 2, "shared").otherwise(F.min("source")).alias("kind"))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"))


SHINGLES = "CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"


@query("shingle_near_duplicates", f"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\v\\f\\r]+'), lambda v: v <> '') AS w FROM documents),
s AS (SELECT doc_id, {SHINGLES} AS s FROM d), x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) AS n, any_value(b.n) AS m FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT a, b, round(i / (n + m - i), 9) AS jaccard FROM p WHERE i / (n + m - i) > 0.8""")
def near_pairs(T):
    return V.shingle_pairs(T("documents"), 5, 0.8).withColumn("jaccard", F.round("jaccard", 9))


@query("length_summary", """SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars, min(length(text)) AS low, max(length(text)) AS high,
quantile_disc(length(text), 0.5) AS p50, quantile_disc(length(text), 0.95) AS p95 FROM documents GROUP BY 1""")
def lengths(T):
    n = F.length("text").cast("long")
    q = lambda p: F.percentile_disc(p, n) if hasattr(F, "percentile_disc") else F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY length(text))").cast("long")
    return T("documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(n).alias("chars"), F.min(n).alias("low"), F.max(n).alias("high"), q(0.5).alias("p50"), q(0.95).alias("p95"))


@query("message_normalise", f"SELECT role, lower(regexp_replace({sql_strip('text')}, '{WS}+', ' ', 'g')) AS message, count(*) AS n FROM conversations WHERE turn < 2 GROUP BY 1, 2")
def messages(T):
    c = T("conversations").where("turn < 2").select("role", S.normalize_message(F.col("text")).alias("message"))
    return c.groupBy("role", "message").agg(F.count("*").alias("n"))


@query("unmapped_messages", """SELECT b.item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE lower(d.text) = lower(b.text))""")
def unmapped(T):
    """Code-book entries without a case-insensitive partner: anti join on lower case."""
    b = T("benchmark").select("item_id", F.lower("text").alias("k"))
    return b.join(T("documents").select(F.lower("text").alias("k")), "k", "left_anti").select("item_id")


@query("pretoken_frequency", "SELECT length(t) AS size, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, ' ?\\p{L}+')) AS t FROM benchmark) GROUP BY 1")
def pretokens(T):
    x = T("benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r" ?\p{L}+"), F.lit(0))).alias("t"))
    return x.groupBy(F.length("t").cast("long").alias("size")).agg(F.count("*").alias("n"))


@query("bpe_round_trip", "SELECT item_id, text AS decoded, true AS same FROM benchmark")
def bpe(T):
    """Byte pairs learned from all pretokens of the benchmark, applied to it and back."""
    b = T("benchmark").select("item_id", "text")
    pairs = V.fit_byte_pairs(b, 300)
    back = V.decode_texts(V.encode_texts(b, pairs), pairs)
    return back.select("item_id", "decoded", (F.col("text") == F.col("decoded")).alias("same"))


@query("byte_pair_counts", """WITH c AS (SELECT lang, list_transform(string_split(left(text, 300), ''), lambda v: unicode(v)) AS ids FROM documents), p AS (SELECT unnest(ids[1:-2]) AS "left", unnest(ids[2:]) AS "right" FROM c)
SELECT "left", "right", count(*) AS n FROM p GROUP BY 1, 2""")
def byte_pair_counts(T):
    letters = F.transform(F.filter(F.split(F.substring("text", 1, 300), ""), lambda v: v != ""), F.ascii)
    return V.pair_counts(T("documents").select(letters.alias("ids"), F.lit(1).alias("w")), "w")


@query("joint_readings", """SELECT item_id, array_to_string(list_concat([9], flatten(list_transform(range(0, 1 + item_id % 3), lambda s: flatten(list_transform([[40, (item_id * 7 + s) % 5 - 1], [41, (item_id + s) % 4 - 1]], lambda p: [p[1], CASE WHEN p[2] < 0 THEN 2 ELSE p[2] + 96 END]))), ), [10]), ',') AS ids FROM benchmark""".replace(", ), [10]", "), [10]"))
def joint_readings(T):
    i = F.col("item_id")
    bins = F.transform(F.sequence(F.lit(0).cast("long"), i % 3), lambda s: F.array(((i * 7 + s) % 5 - 1).cast("int"), ((i + s) % 4 - 1).cast("int")))
    ids = V.joint_readings({"a": 40, "b": 41}, bins, 96, 2, 9, 10)
    return T("benchmark").select("item_id", F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))
