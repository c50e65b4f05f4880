"""Queries of vocabulary coverage, revisions, links and column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage as C
from ..operators import merges as MG
from ..operators import pages as P
from ..operators import vocab as V
from .registry import query
from .text_queries import documents

HALVES = """x AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), h0 AS (SELECT word, count(*) AS n FROM x WHERE doc_id % 2 = 0 GROUP BY 1), h1 AS (SELECT word, count(*) AS n FROM x GROUP BY 1)"""


def halves(T):
    d = documents(T)
    return V.word_counts(d.where("doc_id % 2 = 0"), []), V.word_counts(d, [])


@query("word_moves", f"""WITH {HALVES}, m AS (SELECT coalesce(h0.word, h1.word) AS word, coalesce(h0.n, 0) AS before, coalesce(h1.n, 0) AS after FROM h0 FULL JOIN h1 ON h0.word = h1.word)
SELECT * FROM (SELECT *, CASE WHEN before = 0 AND after >= 30 THEN 'absent -> frequent' WHEN before = 0 AND after > 0 THEN 'absent -> present' WHEN before < 30 AND after >= 30 THEN 'rare -> frequent' WHEN after = 0 AND before > 0 THEN 'present -> absent' WHEN after < 30 AND before >= 30 THEN 'frequent -> rare' END AS kind FROM m) WHERE kind IS NOT NULL""")
def word_moves(T):
    return C.moves(*halves(T), 30)


BOOK = "bw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark)"


@query("check_terms", f"""WITH {HALVES}, {BOOK}, t AS (SELECT DISTINCT lower(p_type) AS term FROM part UNION SELECT word FROM bw WHERE length(word) = 4)
SELECT term, bw.word IS NOT NULL AS in_book, coalesce(h0.n, 0) AS before, coalesce(h1.n, 0) AS after, (coalesce(h0.n, 0) = 0 AND coalesce(h1.n, 0) > 0) OR (coalesce(h0.n, 0) < 30 AND coalesce(h1.n, 0) >= 30) AS moved,
CASE WHEN coalesce(h1.n, 0) > coalesce(h0.n, 0) THEN 'confirmed' ELSE 'no rise' END || '; ' || CASE WHEN bw.word IS NULL THEN 'not in the book' WHEN (coalesce(h0.n, 0) = 0 AND coalesce(h1.n, 0) > 0) OR (coalesce(h0.n, 0) < 30 AND coalesce(h1.n, 0) >= 30) THEN 'moved' WHEN coalesce(h0.n, 0) >= 30 THEN 'frequent before' ELSE 'under the line' END AS verdict
FROM t LEFT JOIN h0 ON h0.word = term LEFT JOIN h1 ON h1.word = term LEFT JOIN bw ON bw.word = term""")
def check_terms(T):
    book = T("benchmark").select(F.explode(V.words(F.col("text"))).alias("word")).distinct()
    terms = T("part").select(F.lower("p_type").alias("term")).union(book.where("length(word) = 4")).distinct()
    return C.check_terms(terms, book, *halves(T), True, 30)


SIDES = f"""{HALVES}, si AS (SELECT DISTINCT lower(text) AS text, CASE WHEN (SELECT coalesce(min(coalesce(n, 0)), 20) FROM (SELECT unnest(regexp_extract_all(lower(b.text), '[a-z]+')) AS word) q LEFT JOIN h1 USING (word)) >= 20 THEN 'high' ELSE 'low' END AS side FROM benchmark b)"""


@query("string_sides", f"WITH {SIDES} SELECT * FROM si")
def string_sides(T):
    return C.partition(T("benchmark"), halves(T)[1], 20)


@query("side_counts", f"""WITH {SIDES}, e AS (SELECT doc_id % 3 AS site, CASE WHEN doc_id % 5 > 0 THEN (SELECT text FROM benchmark WHERE item_id = doc_id % 60) END AS type FROM documents)
SELECT site, count(*) AS events, count(*) FILTER (side IS NULL) AS unmapped, count(*) FILTER (side = 'high') AS high, count(*) FILTER (side = 'low') AS low, count(DISTINCT CASE WHEN side = 'high' THEN type END) AS high_types, count(DISTINCT CASE WHEN side = 'low' THEN type END) AS low_types FROM e LEFT JOIN si ON lower(type) = si.text GROUP BY 1""")
def side_counts(T):
    names = T("benchmark").select(F.col("item_id").alias("k"), F.col("text").alias("type"))
    e = T("documents").select((F.col("doc_id") % 3).alias("site"), F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 60).alias("k")).join(names, "k", "left")
    return C.side_counts(e, C.partition(T("benchmark"), halves(T)[1], 20), ["site"])


CODED = "co AS (SELECT item_id AS key, list_transform(string_split(text, ''), lambda v: unicode(v)) AS ids, text FROM benchmark), cn AS (SELECT token, count(*) AS n FROM (SELECT unnest(list_transform(string_split(left(text, 400), ''), lambda v: unicode(v))) AS token FROM documents) GROUP BY 1)"


def letters(x):
    return F.transform(F.filter(F.split(x, ""), lambda v: v != ""), F.ascii)


def letter_counts(T):
    return T("documents").select(F.explode(letters(F.substring("text", 1, 400))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("token_sides", f"WITH {CODED} SELECT key, count(*) FILTER (r) = 0 AS covered, coalesce(count(*) FILTER (r) = 1 AND min(CASE WHEN r THEN at END) = 0, false) AS first_only FROM (SELECT key, x.at, coalesce(n, 0) < 60 AS r FROM (SELECT key, unnest(ids) AS token, generate_subscripts(ids, 1) - 1 AS at FROM co) x LEFT JOIN cn USING (token)) GROUP BY 1".replace("x.at", "x.pos").replace(" AS at FROM co", " AS pos FROM co").replace("THEN at END", "THEN pos END"))
def token_sides(T):
    return C.token_sides(T("benchmark").select(F.col("item_id").alias("key"), letters(F.col("text")).alias("ids")), letter_counts(T), 60)


@query("convention_coverage", """WITH cn AS (SELECT token, count(*) AS n FROM (SELECT unnest(list_transform(string_split(left(text, 400), ''), lambda v: unicode(v))) AS token FROM documents) GROUP BY 1),
w AS (SELECT DISTINCT 'raw' AS convention, text, text AS raw FROM benchmark UNION ALL SELECT DISTINCT 'leading space only', ' ' || text, text FROM benchmark UNION ALL SELECT DISTINCT 'lowercase only', lower(text), text FROM benchmark UNION ALL SELECT DISTINCT 'normalized', ' ' || lower(text), text FROM benchmark),
c AS (SELECT convention, raw, any_value(text) AS text, bool_and(coalesce(n, 0) >= 60) AS covered, count(*) AS tokens FROM (SELECT *, unnest(list_transform(string_split(text, ''), lambda v: unicode(v))) AS token FROM w) LEFT JOIN cn USING (token) GROUP BY 1, 2)
SELECT convention, count(*) AS strings, count(*) FILTER (covered) AS covered, sum(tokens)::BIGINT AS tokens, sum(length(text))::BIGINT AS chars, sum(octet_length(encode(text)))::BIGINT AS bytes FROM c GROUP BY 1""")
def convention_coverage(T):
    return C.convention_coverage(T("benchmark"), lambda df: df.withColumn("ids", letters(F.col("text"))), letter_counts(T), 60)


@query("compression", "SELECT source, sum(octet_length(encode(text)))::BIGINT AS bytes, sum(len(regexp_extract_all(text, '[a-z]+')))::BIGINT AS tokens, round(sum(octet_length(encode(text))) / sum(len(regexp_extract_all(text, '[a-z]+'))), 9) AS bytes_per_token FROM documents GROUP BY 1")
def compression(T):
    coded = T("documents").select("source", "text", F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)).alias("ids"))
    return C.compression(coded, ["source"]).withColumn("bytes_per_token", F.round("bytes_per_token", 9))


@query("word_forms", f"""WITH {HALVES}, f AS (SELECT item_id AS key, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS form, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+'), 1) - 1 AS pos FROM benchmark)
SELECT key, pos AS place, form, h1.word IS NOT NULL AS known, coalesce(h1.n, 0) AS n FROM f LEFT JOIN h1 ON h1.word = lower(form)""")
def word_forms(T):
    return C.word_forms(T("benchmark").select(F.col("item_id").alias("key"), "text"), halves(T)[1]).withColumnRenamed("at", "place")


@query("site_groups", """WITH m AS (SELECT p_type AS text, count(DISTINCT p_brand) AS n, min(p_brand) AS b FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') GROUP BY 1)
SELECT 'pooled' AS kind, count(*) AS n FROM m UNION ALL SELECT kind, count(*) FROM (SELECT CASE WHEN n = 3 THEN 'shared by all' WHEN n = 1 THEN 'only ' || b ELSE 'some' END AS kind FROM m) GROUP BY 1""")
def site_groups(T):
    said = T("part").where(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13")).select(F.col("p_brand").alias("site"), F.upper("p_type").alias("message"))
    return C.site_groups(C.site_membership(T("part").select(F.col("p_type").alias("text")).distinct(), said), 3)


@query("latest_revisions", """WITH d AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'x' || doc_id ELSE (20240101 + doc_id % 28)::VARCHAR || 'en_en' || (doc_id % 50) END AS doc_id, CASE WHEN doc_id % 4 = 0 THEN 'other' ELSE 'days' END AS source, doc_id AS n FROM documents),
k AS (SELECT *, CASE WHEN source = 'days' THEN nullif(regexp_extract(doc_id, '^(\\d{8})en_(en\\d+)$', 2), '') END AS e, regexp_extract(doc_id, '^(\\d{8})en_', 1) AS day FROM d)
SELECT doc_id, source, n FROM k WHERE e IS NULL UNION ALL SELECT doc_id, source, n FROM (SELECT * FROM k WHERE e IS NOT NULL QUALIFY row_number() OVER (PARTITION BY e ORDER BY day DESC, n DESC) = 1)""")
def latest_revisions(T):
    n = F.col("doc_id")
    named = F.concat((F.lit(20240101) + n % 28).cast("string"), F.lit("en_en"), (n % 50).cast("string"))
    d = T("documents").select(F.when(n % 3 == 0, F.concat(F.lit("x"), n.cast("string"))).otherwise(named).alias("doc_id"), F.when(n % 4 == 0, "other").otherwise("days").alias("source"), n.alias("n"))
    return P.latest_revisions(d, "days", "n")


@query("column_profiles", """WITH x AS (SELECT 'url' AS "column", nullif(trim(url), '') AS v FROM pages UNION ALL SELECT 'html', nullif(trim(html, E' \\n\\t'), '') FROM pages)
SELECT "column", count(v) AS filled, round(avg(length(v)), 6) AS mean_chars, round(count(DISTINCT v) / count(v), 9) AS distinct_share, sum(len(regexp_extract_all(v, '[^ \\t\\n\\v\\f\\r]+')))::BIGINT AS tokens, avg(length(v)) >= 80 AND count(DISTINCT v) / count(v) >= 0.5 AS narrative FROM x GROUP BY 1""")
def column_profiles(T):
    x = P.column_profiles(T("pages"), ["url", "html"])
    return x.withColumn("mean_chars", F.round("mean_chars", 6)).withColumn("distinct_share", F.round("distinct_share", 9))


def merges_sql(merges: int) -> str:
    """Byte pairs of the words of documents, one merge after the other; a word is a string of its ids in brackets."""
    chars = "list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda x: '<' || ('0x' || x)::INT || '>')"
    steps = [f"s0 AS MATERIALIZED (SELECT array_to_string({chars}, '') AS s, n FROM w)"]
    for k in range(merges):
        ids = f"(SELECT regexp_extract_all(s, '[0-9]+') AS i, n FROM s{k})"
        steps.append(
            f"b{k} AS MATERIALIZED (SELECT l, r, sum(n) AS c FROM (SELECT unnest(i[1:-2])::INT AS l, unnest(i[2:])::INT AS r, n FROM {ids} WHERE len(i) > 1) GROUP BY l, r ORDER BY c DESC, l, r LIMIT 1)"
        )
        steps.append(f"s{k + 1} AS MATERIALIZED (SELECT replace(s, (SELECT '<' || l || '><' || r || '>' FROM b{k}), '<{256 + k}>') AS s, n FROM s{k})")
    out = " UNION ALL ".join(f'SELECT {k} AS rank, l AS "left", r AS "right" FROM b{k}' for k in range(merges))
    return f"WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY 1), {', '.join(steps)} {out}"


@query("byte_pair_merges", merges_sql(20))
def byte_pair_merges(T):
    """The first twenty byte pairs of all words of all documents, learned in rounds over a table."""
    docs = T("documents")
    words = docs.select(F.explode(F.split("text", " ")).alias("pretoken")).where("pretoken <> ''").groupBy("pretoken").agg(F.count("*").alias("n"))
    found = [(k, a, b) for k, (a, b) in enumerate(MG.learn_merges(words, 20))]
    return docs.sparkSession.createDataFrame(found, "rank int, left int, right int")
