r"""Chat formatting with a grammar that reads its own output back.

    conversation := turn*
    turn         := "### " role ": " body " </turn>" "\n"      verbatim
                  | "### " role "\: " body " </turn>" "\n"     escaped

A turn is written verbatim if parsing it alone gives the same role and text
back and neither holds a control string (`</turn>`, or `### ` at a line's start),
and escaped otherwise. Escaping maps `\` to `\\`, `<` to `\l`, `#` to
`\h`, `:` to `\c` and line feed to `\n` in both role and text, so an escaped
turn holds none of the marks. The loss mask is a list of spans of code points of
the formatted text: the bodies of the assistant's turns. What it covers is read
by cutting the text there; the mark before a body says whether to unescape it.
All expressions are Spark SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", " </turn>\n"


def _replace(c: Column, a: str, b: str) -> Column:
    return F.replace(c, F.lit(a), F.lit(b))


def escape(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"), ("\n", "\\n")):
        c = _replace(c, a, b)
    return c


def unescape(c: Column) -> Column:
    """The inverse of escape: pairs of backslashes are set apart before single ones are read."""

    def part(p: Column) -> Column:
        for a, b in (("\\l", "<"), ("\\h", "#"), ("\\c", ":"), ("\\n", "\n")):
            p = _replace(p, a, b)
        return p

    return F.array_join(F.transform(F.split(c, r"\\\\"), part), "\\")


def holds_control(c: Column) -> Column:
    return F.contains(c, F.lit(CLOSE.strip())) | F.rlike(c, F.lit(r"(^|\n)### "))


def render(role: Column, text: Column, escaped: bool) -> Column:
    if escaped:
        return F.concat(F.lit(OPEN), escape(role), F.lit("\\: "), escape(text), F.lit(CLOSE))
    return F.concat(F.lit(OPEN), role, F.lit(": "), text, F.lit(CLOSE))


def parse_turn(line: Column) -> Column:
    r"""struct(role, text, ok) of one rendered turn without its CLOSE.

    The head ends at the first ": "; a backslash just before it says that the
    turn is escaped. ok is false where the turn doesn't follow the grammar.
    """
    at = F.locate(": ", line)
    head = F.substring(line, F.lit(len(OPEN) + 1), at - 1 - len(OPEN))
    body = F.substring(line, at + 2, F.length(line))
    esc = F.endswith(head, F.lit("\\"))
    bare = F.substring(head, F.lit(1), F.length(head) - 1)
    ok = F.startswith(line, F.lit(OPEN)) & (at > len(OPEN))
    return F.struct(
        F.when(esc, unescape(bare)).otherwise(head).alias("role"),
        F.when(esc, unescape(body)).otherwise(body).alias("text"),
        ok.alias("ok"),
    )


def parse(formatted: Column) -> Column:
    """array<struct(role, text, ok)> of a rendered conversation; empty for the empty string."""
    lines = F.split(formatted, CLOSE)
    lines = F.slice(lines, F.lit(1), F.size(lines) - 1)
    return F.transform(lines, parse_turn)


def format_conversations(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, formatted and loss_spans, a row per conversation, from rows (conv_id, turn, role, text).

    Turns stand by turn number, then role, then text, nulls first; repeated
    rows are kept. A null role or text counts as empty, a null conv_id is a
    conversation of its own. Turns are rendered and checked one by one before
    they are gathered, so only finished strings of one conversation meet.
    loss_spans are the places (start, end; code points from 0) of the bodies of
    turns whose role is trained, empty ones too. Columns of other names are
    ignored. An empty table gives no rows.
    """
    clean = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    plain = render(F.col("role"), F.col("text"), escaped=False)
    back = parse(plain)
    faithful = (
        (F.size(back) == 1)
        & back[0]["ok"]
        & (back[0]["role"] == F.col("role"))
        & (back[0]["text"] == F.col("text"))
        & ~holds_control(F.col("text"))
        & ~holds_control(F.col("role"))
    )
    rendered = clean.withColumn("line", F.when(faithful, plain).otherwise(render(F.col("role"), F.col("text"), escaped=True)))
    body = F.when(faithful, F.col("text")).otherwise(escape(F.col("text")))
    before = W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("line")).over(before), F.lit(0))
    placed = rendered.select("conv_id", "turn", "role", "text", at.alias("at"), F.length("line").alias("size"), F.length(body).alias("body"), "line")
    end = F.col("at") + F.col("size") - len(CLOSE)
    span = F.struct((end - F.col("body")).alias("start"), end.alias("end"))
    one = placed.select("conv_id", F.struct("turn", "role", "text", "at", span.alias("span"), "line").alias("t"))
    gathered = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    whole = gathered.select("conv_id", F.array_join(F.transform("ts", lambda t: t["line"]), "").alias("formatted"), "ts")
    same = F.transform(parse(F.col("formatted")), lambda p: F.struct(p["role"], p["text"])) == F.transform(
        "ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    )
    return whole.select(
        "conv_id",
        F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a rendered conversation did not parse back to its turns"))).alias("formatted"),
        F.transform(F.filter("ts", lambda t: t["role"] == trained), lambda t: t["span"]).alias("loss_spans"),
    )


def read_conversations(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans and turns (array of role, text, ok), parsed from formatted.

    A null or empty formatted has no turns; rows that repeat are read each;
    text behind the last whole turn is left out.
    """
    return formatted.select("conv_id", "formatted", "loss_spans", F.coalesce(parse(F.col("formatted")), F.array().cast("array<struct<role:string,text:string,ok:boolean>>")).alias("turns"))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask in order: cut from the formatted text, unescaped where the turn is escaped."""

    def cut(s: Column) -> Column:
        body = F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))
        return F.when(F.substring(formatted, s["start"].cast("int") - 2, F.lit(1)) == "\\", unescape(body)).otherwise(body)

    return F.array_join(F.transform(spans, cut), "")


def digest(parsed: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each row of read_conversations(); no rows give none."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = parsed.select("conv_id", "formatted", "turns", F.inline(F.array(F.struct(loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")))))
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, contains(text, '</turn>') OR contains(role, '</turn>') OR regexp_matches(text, '(^|\n)### ') OR regexp_matches(role, '(^|\n)### ') OR contains(role, ': ') OR ends_with(role, '\') OR contains(role || ': ' || text, E' </turn>\n')
            OR contains(text || E' </turn>\n', E' </turn>\n </turn>\n') AS risky,
         replace(replace(replace(replace(replace(text, '\', '\\'), '<', '\l'), '#', '\h'), ':', '\c'), E'\n', '\n') AS etext,
         replace(replace(replace(replace(replace(role, '\', '\\'), '<', '\l'), '#', '\h'), ':', '\c'), E'\n', '\n') AS erole
  FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || E'\n' || text || E'\n', '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN risky THEN length(erole) + length(etext) + 16 ELSE length(role) + length(text) + 15 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
