"""Pages into documents, byte pairs against plain versions, sinks."""

import random

from pyspark.sql import functions as F

from gridloom.operators import pages, vocab
from gridloom.sources import sinks

RNG = random.Random(11)

MODERN = '<html><div class="grid border" id="en1"><b>Event Text</b> <div class="border">First &amp; <i>one</i><br/>line</div></div><div class="grid border" id="en2"><b>Event Text</b><div class="border"> </div></div>'
MIDERA = '<a name="en7"></a><p><b>Event Text</b></p><table class="table"><tbody><tr><td>Seven  words</td></tr></tbody></table><a name="en8"></a>none'
LEGACY = "<pre>\n| Event Number:  123 |\n EVENT TEXT \n+----+\n|  boxed   text &lt;here&gt; |\n|  and more |\n+----+\n Event Number: 456\n EVENT TEXT\n+--+\n| last |\n</pre>"


def test_report_days_in_three_templates(spark):
    rows = [("http://x/2020/20200101en", MODERN), ("http://x/20100101en/", MIDERA), ("http://x/20000101en", LEGACY), ("http://x/none", "<p>no</p>"), ("http://x/null", None)]
    df = spark.createDataFrame(rows, "url string, html string")
    got = {r["doc_id"]: (r["text"], r["template"]) for r in pages.report_days(df).collect()}
    assert got == {
        "20200101en_en1": ("First & one\nline", "modern"), "20100101en_en7": ("Seven words", "midera"),
        "20000101en_en123": ("boxed text <here>\n and more", "legacy"), "20000101en_en456": ("last", "legacy"),
    }
    eras = [r[0] for r in df.where("html is not null").select(pages.marked_template(F.col("html"))).collect()]
    assert eras == ["modern", "midera", "legacy", "unrecognised"]


def test_single_documents_and_links(spark):
    page = '<h1 class="t">A &gt; B</h1><div class="field--name-field-body x">Body<br>text</div><div class="last-modified">'
    links = '<a href="/docs/1999/one"><a href="/docs/1999/one"><a href="/x/2001/two.PDF"><a href="http://o/2002/three.html"><a href="/2003/index"><a href="/r/2003/20030425en">'
    df = spark.createDataFrame([("http://x/2000/doc1/", page), ("http://x/y", links)], "url string, html string")
    assert [tuple(r) for r in pages.single_documents(df).collect()] == [("doc1", "http://x/2000/doc1/", "A > B", "Body\ntext")]
    found = df.where("html like '<a%'").select(pages.document_links(F.col("html"), "https://s"), pages.day_links(F.col("html"), "https://s")).first()
    assert found[0] == ["http://o/2002/three.html", "https://s/docs/1999/one", "https://s/r/2003/20030425en"] and found[1] == ["https://s/r/2003/20030425en"]


def test_fields_and_narratives(spark):
    df = spark.createDataFrame([("1", '"said ""so"" here"'), ("2", " "), (None, "x")], "n string, t string")
    assert sorted(tuple(r) for r in pages.narratives(df, "k", "n", "t").collect()) == [("k", "x"), ("k_1", 'said "so" here')]


def kind(c):
    return "space" if c.isspace() else "letter" if c.isalpha() else "digit" if c.isdigit() else "other"


def plain_pretokens(text):
    runs, i = [], 0
    while i < len(text):
        suffix = next((s for s in ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d") if text.startswith(s, i)), None)
        j = i + len(suffix) if suffix else i + 1
        while not suffix and j < len(text) and kind(text[j]) == kind(text[i]):
            j += 1
        runs.append(text[i:j])
        i = j
    out, k = [], 0
    while k < len(runs):
        run = runs[k]
        if run.isspace() and k + 1 < len(runs):
            out += [run[:-1]] if len(run) > 1 else []
            if run[-1] == " ":
                out.append(" " + runs[k + 1])
                k += 1
            else:
                out.append(run[-1])
        else:
            out.append(run)
        k += 1
    return out


def test_pretokens_match_a_plain_scan():
    for _ in range(4000):
        text = "".join(RNG.choice([" ", "  ", "\n", "a", "é", "1", "²", "!", "'s", "'", "re", "\t", "x9", " '", "ll", "٣", "\x1c"]) for _ in range(RNG.randint(0, 9)))
        assert vocab.pretokenize(text) == plain_pretokens(text)


def test_incremental_merges_match_full_recounts():
    counts = {"".join(RNG.choice("abc") for _ in range(RNG.randint(1, 7))): RNG.randint(1, 9) for _ in range(60)}
    parts, want = [(list(t.encode()), n) for t, n in sorted(counts.items())], []
    for k in range(80):
        seen = {}
        for ids, n in parts:
            for pair in zip(ids, ids[1:], strict=False):
                seen[pair] = seen.get(pair, 0) + n
        if not seen:
            break
        want.append(min(seen, key=lambda p: (-seen[p], p)))
        parts = [(vocab.BytePairs.merged(ids, want[-1], 256 + k), n) for ids, n in parts]
    pairs = vocab.BytePairs.from_pretokens(counts, 80)
    assert pairs.merges == want and pairs.decode(pairs.encode("abcab é cab")) == "abcab é cab" and pairs.id_of_bytes(b"a") == 97 and pairs.id_of_bytes(b"none") is None


def test_manifests_traces_and_assembled_corpora(spark, tmp_path):
    held = spark.createDataFrame([("a", True), ("b", False)], "file string, verified boolean")
    new = sinks.upsert(held, spark.createDataFrame([("b", True), ("c", True)], "file string, verified boolean"), "file")
    assert sorted(tuple(r) for r in new.collect()) == [("a", True), ("b", True), ("c", True)] and sinks.all_verified(new) and not sinks.all_verified(held) and not sinks.all_verified(held.limit(0))
    n = sinks.assemble({"y": held, "x": new}, "all", f"file://{tmp_path}")
    assert n == 5 and [r["source"] for r in spark.read.json(f"{tmp_path}/all").select("source").distinct().orderBy("source").collect()] == ["x", "y"]
    trace = spark.createDataFrame([(1, 0.123456, None), (2, 1234.5, 2.0)], "k long, p double, h double")
    sinks.write_trace(trace, f"file://{tmp_path}/trace", {"p": 4, "h": 2})
    assert sorted(tuple(r) for r in sinks.read_trace(spark, f"{tmp_path}/trace", "k long, p double, h double").collect()) == [(1, 0.1235, None), (2, 1234.5, 2.0)]
