"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat, components, hnsw, licenses, minhash, mixing, repetition, segment, textcore, tokenfiles, toxicity, urlrules

TOKENIZERS = "/opt/tokenizers"
RNG = random.Random(7)


def docs_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def shingle_set(text, k):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))]
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}


def components_of(nodes, edges):
    label = {n: n for n in nodes}
    while True:
        old = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if label == old:
            return label


def near_copies(n_groups=6, copies=7, size=90):
    rows = []
    for _ in range(n_groups):
        base = [RNG.choice("abcdefgh") + str(RNG.randint(0, 500)) for _ in range(size)]
        for c in range(copies):
            words = list(base)
            for _ in range(c * 2 % 9):
                words[RNG.randrange(size)] = f"z{RNG.randint(0, 99999)}"
            rows.append(" ".join(words))
    return rows


def test_near_duplicates_match_all_pairs(spark):
    texts = near_copies() + ["", None, " \t ", "one two", "One  two", "one two three", "A B C D", "a b c d"]
    rows = list(enumerate(texts))
    sets = {i: shingle_set(t, 4) for i, t in rows}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components_of(sets, edges)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs_frame(spark, rows), words=4).collect()}
    assert {i: got[i]["component_id"] for i in sets} == want
    assert all(got[i]["n_shingles"] == len(sets[i]) and got[i]["kept"] == (want[i] == i) for i in sets)


def test_large_bucket_leftovers_are_joined(spark):
    """A chain whose hub is close to few: the rest must be found inside cells."""
    words = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(40):
        words = list(words)
        words[(i * 7) % 60] = f"n{i}"
        rows.append((i, " ".join(words)))
    sets = {i: shingle_set(t, 2) for i, t in rows}
    edges = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components_of(sets, edges)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs_frame(spark, rows), words=2).collect()}
    assert got == want


@pytest.mark.parametrize("side", [2, 1024])
def test_crowded_buckets_lose_no_join(spark, side):
    """Groups of copies at similarity 0.7 and 0.85 and a chain: with a small side, buckets are filed again and dealt to several cells."""
    words = [f"w{k}" for k in range(80)]
    rows = []
    for i in range(60):
        copy = list(words)
        for k in RNG.sample(range(80), 4 if i % 2 else 2):
            copy[k] = f"n{i}.{k}"
        rows.append((i, " ".join(copy)))
    rows = [(i + 3, t) for i, t in rows] + [(1, " ".join(words)), (200, " ".join(words[:40])), (201, " ".join(words[40:]))]
    sets = {i: shingle_set(t, 3) for i, t in rows}
    edges = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components_of(sets, edges)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs_frame(spark, rows), words=3, side=side).collect()}
    assert got == want and len(set(want.values())) > 3


def test_shared_sizes_match_set_intersections():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 90, size=n).astype(np.uint64)) for n in (0, 1, 5, 40, 60, 80, 90)]
    got = minhash.shared_sizes(sets[:4], sets[2:], width=7)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets[:4]]
    assert minhash.shared_sizes(sets[:1], sets[:2]).tolist() == [[0, 0]] and minhash.shared_sizes([], sets).shape == (0, 7)


def test_one_of_repeated_rows_stays_whatever_their_order(spark):
    rows = [(1, "one two three four five six", "a"), (1, "another text of seven words in all", "b"), (2, "one two three four five six", "c"), (None, "x", "d")]
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string, _gone string")
    told = [sorted(map(tuple, minhash.drop_near_duplicates(frame(r)).collect()), key=str) for r in (rows, rows[::-1])]
    assert told[0] == told[1] and len(told[0]) == 2


def test_near_duplicates_odd_tables(spark):
    assert minhash.near_duplicates(docs_frame(spark, [])).count() == 0
    text = " ".join(map(str, range(50)))
    df = spark.createDataFrame([(1, text, "x"), (1, "other words are here now", "y"), (None, text, "z"), (5, "other words are here now", None)], "doc_id long, text string, sig string")
    got = minhash.near_duplicates(df).collect()
    assert len(got) == 4 and {r["doc_id"]: r["component_id"] for r in got} == {1: 1, None: None, 5: 1}
    assert minhash.drop_near_duplicates(df).where("doc_id is not null").count() == 1


def test_shingles_of_a_document_whose_hash_is_zero(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FILTER_BITS", 1 << 15)
    ids = spark.range(400000).where("pmod(xxhash64(id), 32768) in (0, 1, 32767)").select(F.col("id").alias("doc_id"))
    docs = ids.withColumn("text", F.concat(F.lit("a b c d "), F.col("doc_id").cast("string")))
    hit = ids.where("pmod(xxhash64(doc_id), 32768) = 0")
    want = {r["doc_id"] for r in hit.collect()}
    assert want and {r["doc_id"] for r in minhash.shingled(docs, hit, 4).collect()} == want


def test_posterior_bounds_grow_and_keep_true_links():
    bounds = minhash.least_agreeing(160, 0.8, 1e-6)
    assert [n for n, _ in bounds] == [32, 64, 96, 128, 160] and all(m < n * 0.8 for n, m in bounds)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(0, k) for k in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 100 for k in range(100, 141)) and all(got[k] == 0 for k in range(30))


def brute_repeats(words):
    out = [0] * len(words)
    for i in range(len(words)):
        for j in range(len(words)):
            k = 0
            while i != j and max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return [v if v >= repetition.BASE else 0 for v in out]


def test_suffix_array_matches_brute_force():
    for _ in range(40):
        docs = [[RNG.choice("abc"[: RNG.randint(1, 3)]) for _ in range(RNG.randint(0, 30))] for _ in range(4)]
        words = textcore.Words(*textcore.utf8(pa.array([" ".join(d) for d in docs])))
        assert list(repetition.repeat_lengths(words.hashes(), words.first)) == [v for d in docs for v in brute_repeats(d)]


def test_covered_words_are_the_union_of_maximal_repeats():
    """Maximal by definition: all pairs of occurrences that can be extended on neither side."""
    for _ in range(60):
        words = [RNG.choice("abcd"[: RNG.randint(1, 4)]) for _ in range(RNG.randint(0, 40))]
        want = set()
        for i in range(len(words)):
            for j in range(i + 1, len(words)):
                if i and words[i - 1] == words[j - 1]:
                    continue
                k = 0
                while j + k < len(words) and words[i + k] == words[j + k]:
                    k += 1
                if k >= 4:
                    want |= set(range(i, i + k)) | set(range(j, j + k))
        found = textcore.Words(*textcore.utf8(pa.array([" ".join(words)])))
        lengths = repetition.repeat_lengths(found.hashes(), found.first)
        assert set(np.flatnonzero(repetition.covered(lengths, 4)).tolist()) == want


def test_repetition_of_odd_tables_and_very_long_texts(spark):
    long = [f"w{k}" for k in range(300_000)]
    rows = [(1, " ".join(long + long[1000:1200])), (2, "a b c d e f g h i"), (2, "a b c d e f g h i"), (None, None)]
    df = docs_frame(spark, rows).withColumn("_m", F.lit("clash"))
    got = repetition.judge_repeats(repetition.measure_repeats(df)).collect()
    one = next(r for r in got if r["doc_id"] == 1)
    assert len(got) == 4 and (one["n_words"], one["longest_repeat"], one["covered_words"], one["n_maximal"], one["kept"]) == (300_200, 200, 400, 2, False)
    assert repetition.measure_repeats(df.limit(0)).count() == 0 and repetition.drop_repetitive(df.limit(0)).count() == 0
    assert repetition.drop_repetitive(df).columns == df.columns


def test_repetition_measures_and_verdict(spark):
    clean = " ".join(f"w{k}" for k in range(80))
    rows = [(0, clean), (1, None), (2, ""), (3, "a # b\n \na # b\nc"), (4, " ".join(["same old line of words again and again here"] * 20)), (5, "é é " * 40)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, kept int")
    got = {r["doc_id"]: r for r in repetition.judge_repeats(repetition.measure_repeats(df)).collect()}
    assert (got[0]["n_words"], got[0]["kept"], got[0]["longest_repeat"]) == (80, True, 0)
    assert got[1]["n_words"] == 0 and got[1]["base_failed"] and not got[2]["kept"]
    assert (got[3]["n_symbols"], got[3]["n_dup_lines"], got[3]["word_chars"], got[3]["n_repeat_words"]) == (2, 1, 7, 6)
    assert not got[4]["kept"] and got[4]["spans"][0]["start"] == 0 and got[4]["spans"][0]["end"] == len(rows[4][1])
    assert got[5]["n_repeat_words"] == 80 and got[5]["word_chars"] == 80
    kept = repetition.drop_repetitive(df)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [0]


def test_toxicity_on_held_out_rows(spark):
    bad = ["vile", "scumbag", "rotten", "foulness"]
    filler = [a + b + c for a in ("th", "er", "on") for b in ("an", "in", "or") for c in ("ed", "es", "ing")]
    rows, labels = [], []
    for i in range(1600):
        words = [RNG.choice(filler) for _ in range(RNG.randint(30, 120))]
        toxic = int(i % 5 == 0)
        for _ in range(toxic * RNG.randint(2, 4)):
            words[RNG.randrange(len(words))] = RNG.choice(bad) + RNG.choice(["", "s", "ly"])
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    rows += [(9000, None), (9001, "")]
    got = toxicity.score_toxicity(docs_frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == 1602 and all(0 <= r["score"] <= 1 for r in got)
    held = [(r["predicted"], dict(labels)[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] < 9000]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    none = toxicity.score_toxicity(docs_frame(spark, rows[:3]), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(none) == 3


def test_toxicity_of_very_long_texts(spark):
    filler = [a + b + c for a in ("th", "er", "on", "li") for b in ("an", "in", "or", "u") for c in ("ed", "es", "ing", "o")]
    rare = lambda: "".join(RNG.choice("aeioustrnl") for _ in range(7))
    ordinary = lambda n: [RNG.choice(filler) if RNG.random() < 0.9 else rare() for _ in range(n)]
    rows, labels = [], []
    for i in range(1200):
        words = ordinary(RNG.randint(30, 120))
        toxic = int(i % 5 == 0)
        for _ in range(toxic * 5):
            words[RNG.randrange(len(words))] = RNG.choice(["vile", "scumbag", "rotten"]) + RNG.choice(["", "s", "ly"])
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    rows += [(9000 + k, " ".join(ordinary(7500))) for k in range(8)]
    rows += [(9100 + k, " ".join(ordinary(3000) + ["vile", "scumbags", "rottenly", "scumbag", "viles"] + ordinary(3000))) for k in range(8)]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs_frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert sum(got[9000 + k] for k in range(8)) == 0 and sum(got[9100 + k] for k in range(8)) == 8


def test_toxicity_counts_grow_with_the_input(spark):
    """Words of rows beyond max_docs count, and the shared counts are those of all texts."""
    rows = [(i, f"common words {'zq' if i % 2 else 'kj'}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x") for i in range(1300)]
    df, labels = docs_frame(spark, [*rows, (5000, "unlabelled")]), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, max_docs=20)[0].value
    counted, curve = toxicity.training_rows(labels, 20)
    assert curve.count() == 40 and counted.count() == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i, _ in rows) - 40
    of = {r["doc_id"]: r["toxic"] for r in counted.collect()}
    texts = {c: {t for i, t in rows if of.get(i) == c} for c in (1, 0)}

    def grams(word):
        spelt = "\1" + word + "\2"
        return [spelt[max(0, k - 5) : k + 1] for k in range(1, len(spelt))]
    n = {c: Counter(g for t in texts[c] for w in set(t.split()) for g in grams(w)) for c in texts}
    everything = {g for _, t in [*rows, (0, "unlabelled")] for w in t.split() for g in grams(w)}

    def p(g):
        if not g:
            return 1 / 256
        longer = {y[-len(g) - 1 :] for y in everything}
        same = Counter(x[-len(g) :] for x in longer if len(x) >= len(g) and x[-len(g) : -1] == g[:-1])
        total = sum(same.values())
        return max(same[g] - 0.75, 0) / total + 0.75 * len(same) / total * p(g[1:])

    g = "common"
    told = []
    for c in (1, 0):
        same = {x: k for x, k in n[c].items() if len(x) == 6 and x[:-1] == g[:-1]}
        total = sum(same.values())
        told.append(max(same[g] - 0.75, 0) / total + 0.75 * len(same) / total * p(g[1:]))
    at = int(np.searchsorted(model.keys, int.from_bytes(g.encode(), "big")))
    assert model.keys[at] == int.from_bytes(g.encode(), "big") and abs(model.ratio[at] - math.log(told[0] / told[1])) < 1e-9


def test_evidence_matches_a_plain_kneser_ney(spark):
    """All letters of all words by recursion over strings; a word's ratio by the mixture; the mean of the strongest passage."""
    RNG2 = random.Random(5)
    word = lambda: "".join(RNG2.choice("abcd") for _ in range(RNG2.randint(1, 7)))
    rows = [(i, " ".join(word() for _ in range(RNG2.randint(1, 100)))) for i in range(120)] + [(500, "new abcd é"), (501, None), (502, "")]
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(100)], "doc_id long, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    df = docs_frame(spark, rows)
    model = toxicity.fit(df, labels, max_docs=5)[0].value
    of = {r["doc_id"]: r["toxic"] for r in toxicity.training_rows(labels, 5)[0].collect()}
    order, d = toxicity.ORDER, toxicity.D

    def grams(w):
        spelt = b"\1" + w.encode() + b"\2"
        return [spelt[max(0, k - order + 1) : k + 1] for k in range(1, len(spelt))]

    split = lambda t: __import__("re").findall(r"[A-Za-z0-9\x80-\U0010ffff]+", t or "")
    seen = {g for _, t in rows for w in split(t) for g in grams(w)}
    n = {c: Counter(g for t in {t for i, t in rows if of.get(i) == c} for w in set(split(t)) for g in grams(w)) for c in (1, 0)}
    # grams are padded to full length, so each lower order is that of the one above without its first byte
    full = {g.rjust(order, b"\0") for g in seen}
    levels = {order: full}
    for k in range(order - 1, 0, -1):
        levels[k] = {g[1:] for g in levels[k + 1]}

    def shared(g):
        if not g:
            return 1 / 256
        same = Counter(x[1:] for x in levels[len(g) + 1] if x[1:-1] == g[:-1])
        total = sum(same.values())
        if not total:
            return shared(g[1:])
        return max(same[g] - d, 0) / total + d * len(same) / total * shared(g[1:])

    def ratio(g):
        told = []
        for c in (1, 0):
            same = {x: k for x, k in n[c].items() if x.rjust(order, b"\0")[:-1] == g.rjust(order, b"\0")[:-1]}
            total = sum(same.values())
            p = max(same.get(g, 0) - d, 0) / total + d * len(same) / total * shared(g.rjust(order, b"\0")[1:]) if total else shared(g.rjust(order, b"\0")[1:])
            told.append(p)
        return math.log(told[0] / told[1])

    known = {}
    for i, text in rows[:12] + rows[-3:]:
        by_word = []
        for w in split((text or "").lower()):
            if w not in known:
                known[w] = math.log1p(toxicity.INSULTS * math.expm1(sum(map(ratio, grams(w)))))
            by_word.append(known[w])
        width = min(len(by_word), toxicity.PASSAGE)
        best = max((sum(by_word[k : k + width]) / width for k in range(len(by_word) - width + 1)), default=0) * toxicity.PASSAGE if width else 0
        got = model.evidence(pa.array([text], pa.string()))[0]
        assert abs(got - math.copysign(math.sqrt(abs(best)), best)) < 1e-6, (i, got, best)


def test_toxicity_of_odd_tables(spark):
    rows = [(i, f"some words {'vile' if i % 2 else 'kind'} text", "x") for i in range(60)] + [(1, "vile again", "y"), (None, "vile", "z"), (70, None, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(df, labels).collect()
    assert len(got) == 63 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.drop_toxic(df, labels).columns == df.columns
    assert toxicity.score_toxicity(df.limit(0), labels).count() == 0
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["score"])
    table = sorted(toxicity.score_toxicity(df, labels, most_grams=3).collect(), key=key)  # a model that no worker holds
    for a, b in zip(sorted(got, key=key), table, strict=True):
        assert a["doc_id"] == b["doc_id"] and abs(a["score"] - b["score"]) < 1e-9 and abs(a["evidence"] - b["evidence"]) < 1e-9 and a["predicted"] == b["predicted"]
    assert sorted(map(str, toxicity.drop_toxic(df, labels).collect())) == sorted(str(r) for r in toxicity.add_score(df, labels, "_q", most_grams=3).where("_q.score < 0.3").drop("_q").collect())


def test_toxicity_by_tables_of_words_and_grams_is_the_same(spark):
    vile = ["krang", "krangs", "Zorbling", "vlékt"]
    words = ["haus", "baum", "l'été", "mer", "a", "überall", "x1"]
    rows = []
    for i in range(120):
        text = " ".join(RNG.choices(words, k=RNG.choice([1, 5, 90, 400])))
        rows.append((i, text + (" " + RNG.choice(vile) + "! " + text if i % 4 == 1 else "")))
    rows += [(200, ""), (201, None), (202, " ,;. "), (203, "krang " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 1)) for i in range(0, 120)], "doc_id long, toxic int")
    told = [{r["doc_id"]: (r["score"], r["evidence"], r["predicted"]) for r in toxicity.score_toxicity(df, labels, most_grams=n).collect()} for n in (toxicity.MOST_GRAMS, 0)]
    assert set(told[0]) == set(told[1]) and all(abs(a - b) < 1e-7 for i in told[0] for a, b in zip(told[0][i], told[1][i], strict=True))


def test_near_duplicates_of_rows_with_maps(spark):
    df = spark.createDataFrame([(1, "a b c d e f", {"x": 1}), (1, "a b c d e f", {"x": 1}), (2, "a b c d e f", {"y": 2})], "doc_id long, text string, m map<string,int>")
    kept = minhash.drop_near_duplicates(df).collect()
    assert [(r["doc_id"], r["m"]) for r in kept] == [(1, {"x": 1})]


def test_strongest_passages_match_brute_force():
    first = np.array([0, 0, 3, 70, 134, 400, 400])
    by_word = np.random.default_rng(3).normal(size=400)
    got = toxicity.strongest_passages(by_word, first)
    for a, b, x in zip(first[:-1], first[1:], got, strict=True):
        width = min(b - a, toxicity.PASSAGE)
        want = toxicity.PASSAGE * max(by_word[k : k + width].sum() / max(width, 1) for k in range(a, b - width + 1))
        assert abs(x - math.copysign(math.sqrt(abs(want)), want)) < 1e-9


def test_license_lines_and_inheritance(spark):
    rows = [
        (1, "a/b/x", "some words\nReleased under the MIT License.\n" + "more words of text " * 9),
        (2, "a/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (3, "a/b/c/y", "nothing here at all"),
        (4, "z/y", "nothing here"),
        (5, None, None),
        (6, "a/b/LICENSE", "This work is licensed under the GNU General Public License, version 3."),
        (7, "a/q", ""),
        (8, "z/q", "no word of a license is said in this text of many other words today"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("clash"))
    got = {r["doc_id"]: (r["license"], r["basis"]) for r in licenses.scan(df).collect()}
    assert got[1] == ("MIT", "header") and got[2] == ("Apache-2.0", "file") and got[6] == ("GPL-3.0", "file")
    assert got[3] == ("GPL-3.0", "inherited") and got[7] == ("Apache-2.0", "inherited")
    assert got[4] == (None, None) and got[5] == (None, None) and got[8] == (None, None)


def brute_licenses(rows, notices, texts, threshold=0.6):
    """Every stretch of every text against every notice, and every whole text against every licence text: the best licence and its basis."""
    terms = {i: licenses.template_terms(t or "") for i, _, t in rows}
    share = Counter(t for w in terms.values() for t in set(w))
    weigh = lambda w: {t: (1 + math.log(n)) * licenses.term_weight(share[t] / len(rows)) for t, n in Counter(w).items()}

    def cos(a, b):
        norm = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
        return round(sum(x * b.get(t, 0) for t, x in a.items()) / norm, 9) if norm else 0

    notices = [(name, licenses.template_terms(t)) for name, t in notices]
    texts = [(name, weigh(licenses.template_terms(t))) for name, t in texts]
    vectors = [weigh(t) for _, t in notices]
    out = {}
    for i, w in terms.items():
        tried = [(-cos(weigh(w[k : k + len(t)]), v), name) for (name, t), v in zip(notices, vectors, strict=True) for k in range(len(w))]
        best = min(tried, default=(0, None))
        whole = min(((-cos(weigh(w), v), name) for name, v in texts), default=(0, None))
        out[i] = (whole[1], "file") if whole[0] <= -threshold else (best[1], "header") if best[0] <= -threshold else (None, None)
    return out


def test_wrapped_commented_and_whole_licences_match_all_stretches(spark):
    text = dict((len(t), (n, t)) for n, t in licenses.TEMPLATES)
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 500)
    gpl = next(t for n, t in licenses.TEMPLATES if n == "GPL-3.0" and len(t) > 300)
    wrap = lambda t, mark, n: "\n".join(mark + " ".join(t.split()[k : k + n]) for k in range(0, len(t.split()), n))
    filler = lambda n: " ".join(f"word{RNG.randint(0, 400)}" for _ in range(n))
    rows = [
        (1, None, "Copyright (c) 2020 Some One\n\n" + wrap(mit, "", 11)),
        (2, None, wrap(gpl, " * ", 9) + "\n" + filler(400)),
        (3, None, filler(200) + " Licensed under the Apache License, Version 2.0 " + filler(200)),
        (4, None, filler(50) + "\n# Licensed under the\n# Apache License,\n# Version 2.0\n" + filler(80)),
        (5, None, "the license of this work is a matter of some debate among people who publish software"),
        (6, None, filler(5) + " dedicated to the public domain under cc0"),
        (7, None, ""), (8, None, None), (9, None, "redistribution and use in source"),
    ] + [(20 + k, None, filler(60)) for k in range(10)]
    got = {r["doc_id"]: (r["license"], r["basis"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    want = brute_licenses(rows, licenses.TEMPLATES, licenses.license_texts())
    assert len(text) and got == want and [want[k] for k in (1, 2, 3, 4)] == [("MIT", "file"), ("GPL-3.0", "header"), ("Apache-2.0", "header"), ("Apache-2.0", "header")]


def test_whole_licences_keep_their_names_and_license_their_directories(spark):
    words = [f"word{k}" for k in range(400)]
    filler = lambda n: " ".join(RNG.choice(words) for _ in range(n))
    texts = licenses.license_texts()
    rows = [(k, f"p{k}/{'LICENSE' if k % 2 else 'notes'}", "Copyright 2020 Some One\n\n" + t) for k, (_, t) in enumerate(texts)]
    mit = next(t for n, t in texts if n == "MIT")
    weak = " ".join(w for w in mit.split() if licenses.template_terms(w) and licenses.template_terms(w)[0] not in {"mit", "permission", "hereby", "granted", "charge", "sublicense", "noninfringement"})
    rows += [(100 + k, f"p{k}/src/a.c", filler(30)) for k in range(len(texts))] + [(200, "q/terms.txt", weak), (201, "q/a.c", filler(9)), (202, "r/x", "Released under the MIT License"), (203, "r/y", filler(5))]
    rows += [(300 + k, None, filler(80)) for k in range(60)]
    got = {r["doc_id"]: (r["license"], r["basis"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    for k, (name, _) in enumerate(texts):
        assert got[k] == (name, "file") and got[100 + k] == (name, "inherited"), name
    assert got[200] == ("MIT", "file") and got[201] == ("MIT", "inherited")
    assert got[202] == ("MIT", "header") and got[203] == (None, None)  # a line is no licence file
    assert all(got[300 + k] == (None, None) for k in range(60))


def test_verdicts_of_a_line_are_the_same_at_every_size():
    line = licenses.template_terms("Licensed under CC BY-NC 4.0 by the author and editors of this work")
    common = {"under": 0.02, "by": 0.4, "the": 0.9, "and": 0.85, "of": 0.9, "this": 0.5, "author": 0.001, "licensed": 0.01, "cc": 0.004, "nc": 0.003, "4": 0.05, "0": 0.08}
    told = []
    for n in (10_000, 10_000_000, 10**9):
        weights = {t: 1 - math.log(round(n * p) / n) for t, p in common.items()}
        template = licenses.Template.of("x", "Licensed under CC BY-NC 4.0", weights, False)
        mine = {t: (1 + math.log(c)) * weights.get(t, licenses.term_weight(0.0)) for t, c in Counter(line).items()}
        told.append(sum(x * template.unit.get(t, 0) for t, x in mine.items()) / math.sqrt(sum(x * x for x in mine.values())))
    assert max(told) - min(told) < 1e-6


def test_licenses_of_odd_tables(spark):
    schema = "doc_id long, path string, text string, terms int"
    notice = "Released under the MIT License."
    rows = [
        (1, "a/LICENSE", notice, 1), (1, "a/LICENSE", notice, 1), (2, "a/y", "nothing", 2), (None, "a/z", notice, 3), (3, "b/copying.txt", "Licensed under CC BY 4.0", 4), (4, "b/w", "Licensed under CC BY-SA 4.0", 5),
        (5, "b/c/d", None, 6), (6, "c/license", "no licence is named here", 7), (7, "c/x", "", 8), (8, None, "word " * 300_000 + notice, 9),
    ]
    got = sorted(((r["doc_id"], r["license"], r["basis"]) for r in licenses.scan(spark.createDataFrame(rows, schema)).collect()), key=str)
    want = [(1, "MIT", "file")] * 2 + [(2, "MIT", "inherited"), (None, "MIT", "inherited"), (3, "CC-BY-4.0", "file"), (4, "CC-BY-SA-4.0", "header"), (5, "CC-BY-4.0", "inherited"), (6, None, None), (7, None, None), (8, "MIT", "header")]
    assert got == sorted(want, key=str)
    assert licenses.scan(spark.createDataFrame([], schema)).count() == 0


def mix_brute(rows, weights=(3, 1, 2)):
    size = {i: len((t or "").split()) for i, _, t in rows}
    total = Counter()
    for i, s, _ in rows:
        total[s] += size[i]
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    target, open_, budget = {}, set(order), 1.5 * sum(total.values())
    while open_:
        rate = budget / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * rate >= 2 * total[s]}
        if not over:
            target.update({s: weight[s] * rate for s in open_})
            break
        for s in over:
            target[s] = 2.0 * total[s]
            budget -= target[s]
        open_ -= over
    return size, total, target


def test_mix_meets_targets(spark):
    rows = [(i, RNG.choice(["a", "b", "c", None, "é"]), " ".join(["w"] * RNG.randint(0, 30)) if i % 9 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    size, total, target = mix_brute(rows)
    got = mixing.mix_plan(df).collect()
    taken = Counter()
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[r["source"]]
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) < 1 for s in total)
    mixed = mixing.apply_mix(df, mixing.mix_plan(df))
    words = Counter()
    for r in mixed.collect():
        words[r["source"]] += len(r["text"].split())
    assert words == taken and mixed.columns == df.columns
    assert mixing.mix_plan(df.limit(0)).count() == 0


def test_mix_counts_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a", "x y z")] * 3 + [(1, "a", "q")], "doc_id long, source string, text string")
    assert sum(r["taken"] for r in mixing.mix_plan(df).collect()) == 15
    assert sum(len(r["text"].split()) for r in mixing.apply_mix(df, mixing.mix_plan(df)).collect()) == 15


def test_mix_of_null_ids_and_clashing_columns(spark):
    rows = [(None, "a", "x y z", 1, 9), (2, None, "p q", 2, 9), (3, "a", None, 3, 9), (2, None, "p q", 4, 9), (4, "a", " lead and trail ", 5, 9)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, _words int, n_chars long")
    plan = mixing.mix_plan(df)
    mixed = mixing.apply_mix(df, plan)
    assert mixed.columns == df.columns and plan.count() == 5
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) == sum(r["taken"] for r in plan.collect())
    once = df.where("_words <> 4")
    assert sum(len((r["text"] or "").split()) for r in mixing.apply_mix(once, mixing.mix_plan(once)).collect()) == sum(r["taken"] for r in mixing.mix_plan(once).collect())


def test_url_rules_and_parsing(spark):
    urls = ["HTTP://A.Example.COM/en/7x?q", "http://sub.example.net/de/81", "http://x.org/es", "http://x.org/es/1", "no scheme", None, "ftp://b.com:80/en/1#f", "http://com/en/2"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    bad = spark.createDataFrame([(f"http://spam-{k % 3}.pills.biz/shop/{k}", True) for k in range(30)] + [(f"http://good{k}.biz/shop/{k}", False) for k in range(60)], "url string, bad boolean")
    got = {r["page_id"]: r for r in urlrules.filter_urls(df, bad).collect()}
    assert [got[k]["rule"] for k in range(8)] == ["example.com/en/7", "example.net/de/8", None, "org/es/", None, None, None, "com/en/"]
    assert (got[0]["host"], got[0]["path"]) == ("a.example.com", "/en/7x") and (got[4]["host"], got[4]["path"], got[5]["host"]) == ("", "", "")
    assert got[1]["verdict"] == "allow" and got[3]["verdict"] == "block" and got[4]["verdict"] == "allow"
    spam = urlrules.filter_urls(spark.createDataFrame([(1, "http://w.pills.biz/shop/9"), (2, "http://ok.biz/shop/1")], "page_id long, url string"), bad)
    assert {r["page_id"]: r["verdict"] for r in spam.collect()} == {1: "block", 2: "allow"}
    assert urlrules.filter_urls(df, bad.limit(0)).count() == 8


def test_url_rules_say_the_words_of_the_contract(spark):
    urls = {"http://a.com/en/1": "block", "http://b.example.com/en/71": "allow", "http://x.net/de/8": "allow", "http://example.net/de/7": "allow", "http://sub.example.net/de/81": "block", "http://x.org/es/1": "block"}
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "url string, bad boolean")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlrules.filter_urls(df, none).collect()}
    assert [got[k] for k in range(6)] == list(zip(["com/en/", "example.com/en/7", "net/de/", "net/de/", "example.net/de/8", "org/es/"], urls.values(), strict=True))


def url_token_set(url):
    import re

    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url)
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    labels = [x for x in host.split(".") if x]
    parts = [y for x in labels if "-" in x for y in x.split("-")]
    segments = [x for x in re.sub("[0-9]+", "#", path).split("/") if x]
    query = re.search(r"\?([^#]*)", url)
    keys = [x.split("=")[0] for x in query[1].split("&") if x] if query else []
    return {"h:" + x for x in labels} | {"w:" + x for x in parts} | {"p:" + x for x in segments} | {"q:" + x for x in keys}


def test_mined_rules_match_all_combinations(spark):
    from itertools import combinations

    def url():
        host = RNG.choice(["a", "b-c", "spam", "x"]) + "." + RNG.choice(["biz", "org"])
        return f"http://{host}/{RNG.choice(['en', 'de', 'shop'])}/{RNG.randint(1, 99)}" + RNG.choice(["", "?ref=1", "?id=2&ref=x"])

    rows = [(u, "spam" in u and "shop" in u or "q" in u or RNG.random() < (0.7 if "b-c" in u and "de" in u else 0.1)) for u in (url() for _ in range(300))]
    rows += [(None, True), ("http://n.n/", None)]
    sets = [(url_token_set(u), bad) for u, bad in rows if u and bad is not None]
    n, base, least = len(sets), sum(b for _, b in sets) / len(sets), 12
    rules = {}
    for items in {c for s, _ in sets for k in range(1, len(s) + 1) for c in combinations(sorted(s), k)}:
        hits = [b for s, b in sets if s.issuperset(items)]
        if sum(hits) >= least and sum(hits) / len(hits) >= 0.6 and sum(hits) / len(hits) / base >= 1.5:
            rules[items] = sum(hits) / len(hits)
    want = {i: c for i, c in rules.items() if not any(set(j) < set(i) and d >= c for j, d in rules.items())}
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    mined = urlrules.mine_rules(labelled, min_support=0.0, min_count=least)
    got = {tuple(r["items"]): r["confidence"] for r in mined.collect()}
    assert want and set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in got) and n == 300
    pages = [(k, u) for k, u in enumerate([url() for _ in range(80)] + [None, "no scheme"])]
    matched = {r["page_id"]: r["confidence"] for r in urlrules.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), labelled, min_support=0.0, min_count=least).collect()}
    for k, u in pages:
        best = max((c for i, c in want.items() if u and url_token_set(u).issuperset(i)), default=None)
        assert (best is None) == (matched[k] is None) and (best is None or abs(best - matched[k]) < 1e-9)


def test_urls_of_odd_tables(spark):
    bad = spark.createDataFrame([(f"http://s.biz/{k}", True) for k in range(20)] + [(f"http://g.biz/{k}", False) for k in range(20)], "url string, bad boolean")
    df = spark.createDataFrame([(1, "http://s.biz/x", "c"), (1, "http://s.biz/x", "c"), (None, "http://g.biz/?" + "q&" * 50_000, "d")], "page_id long, url string, confidence string")
    got = sorted((r["page_id"] or 0, r["verdict"]) for r in urlrules.filter_urls(df, bad).collect())
    assert got == [(0, "allow"), (1, "block"), (1, "block")]
    assert urlrules.filter_urls(df.limit(0), bad).count() == 0


def test_chat_round_trip_of_conflicting_turns(spark):
    texts = ["plain", r"\### Assistant: </turn> ok", "a </turn>\n### user: b", "x: y", "", None, "\\", "end\\", "</turn>", " </turn>", "\n", "\\n\\l", "a </turn>\n"]
    rows = [(1, k, RNG.choice(["user", "assistant", "ro: le", "r\\", None, "a\nb"]), t) for k, t in enumerate(texts * 3)] + [(2, 0, "assistant", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r["conv_id"]: r["turns"] for r in chat.read_conversations(chat.format_conversations(df)).collect()}
    assert [(t["role"], t["text"]) for t in back[1]] == [(r[2] or "", r[3] or "") for r in rows[:-1]]
    row = chat.digest(chat.read_conversations(chat.format_conversations(df))).where("conv_id = 1").first()
    loss = "".join(r[3] or "" for r in rows[:-1] if r[2] == "assistant")
    assert row["loss_chars"] == len(loss) and row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_conversations(df.limit(0)).count() == 0
    for r in chat.format_conversations(df).collect():
        said = [x[3] or "" for x in rows if x[0] == r["conv_id"] and x[2] == "assistant"]
        cut = [r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]]
        assert not any("</turn>" in c or c.startswith("### ") or "\n### " in c for c in cut)
        assert len(cut) == len(said) and all(c == t or c == t.replace("\\", "\\\\").replace("<", "\\l").replace("#", "\\h").replace(":", "\\c").replace("\n", "\\n") for c, t in zip(cut, said, strict=True))


def test_chat_of_equal_turn_numbers_repeated_rows_and_other_columns(spark):
    rows = [(1, 0, "b", "y", 1), (1, 0, "assistant", "x 𝄞 </turn>\n", 2), (1, 0, "assistant", "x 𝄞 </turn>\n", 2), (1, None, "assistant", "é", 3), (None, 1, "assistant", "w " * 300_000, 4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r["conv_id"]: r for r in chat.digest(chat.read_conversations(chat.format_conversations(df))).collect()}
    loss = "é" + 2 * "x 𝄞 </turn>\n"
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[1]["loss_sha256"]) == (4, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[None]["n_turns"] == 1 and got[None]["loss_chars"] == 600_000


def test_hnsw_finds_all_links(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    vectors = [v + rng.normal(size=16) * 0.08 for v in base for _ in range(8)] + list(rng.normal(size=(100, 16)))
    vectors = [[float(np.float32(x)) for x in v] for v in vectors]
    vectors += [vectors[0], vectors[0], [0.0] * 16, [float("nan")] * 16, [None] * 16, None, []]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    good = {i: np.array(v) for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and any(v)}
    edges = [(a, b) for a in good for b in good if a < b and good[a] @ good[b] / (np.linalg.norm(good[a]) * np.linalg.norm(good[b])) >= 0.9]
    degree, want = Counter(), components_of(range(len(vectors)), edges)
    for a, b in edges:
        degree[a] += 1
        degree[b] += 1
    got = {r["vec_id"]: r for r in hnsw.link_embeddings(df, shards=2).collect()}
    assert len(got) == len(vectors)
    assert {i: got[i]["component_id"] for i in got} == want and {i: got[i]["n_links"] for i in got} == {i: degree[i] for i in got}


def test_graphs_of_few_vectors_are_built_and_searched():
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 16, 17, 60):
        for _ in range(8):
            ids, v = rng.integers(-(1 << 62), 1 << 62, n), rng.normal(size=(n, 8)).astype(np.float32)
            graph = hnsw.Graph.loads(hnsw.Graph(ids, np.ones(n, np.int64), v).dumps())
            queries = hnsw.Queries(ids, v)
            found = graph.audited_links(queries, 0.5, 4, 8, 1.0)
            row, _ = graph.exact(queries, 0.5)
            assert found.count.sum() >= 0.9 * len(row)


@pytest.mark.parametrize("n", [0, 1, 2, 17])
def test_small_embedding_tables(spark, n):
    rows = [(i, [1.0, float(i % 2)], "x") for i in range(n)]
    got = hnsw.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string"), with_recall=True).collect()
    assert len(got) == n and all(r["component_id"] == r["vec_id"] % 2 and r["n_links"] == (n - r["vec_id"] % 2 + 1) // 2 - 1 for r in got)


def test_embeddings_under_one_id_and_of_mixed_lengths(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [0.02, 1.0]), (5, [1.0, 0.0, 0.0]), (6, [1.0, 0.0, 0.01]), (7, [1.0, 0.0]), (7, [1.0, 0.0])]
    got = hnsw.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [
        (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 2, 1), (5, 1, 5), (6, 1, 5), (7, 2, 1), (7, 2, 1)
    ]


def test_chunk_encoder_equals_the_library(monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    encoder = tokenfiles.ChunkEncoder(tokenizer)
    texts = ["", " ", "a  b", "it's 12 34ab  !!", "<|endoftext|> x", "a<|endoftext|>b", "q <|endoftext|> r <|endoftext|>", "q \0a", "é　 x\n y"]
    texts += ["".join(RNG.choice([" ", "\n", "a", "1", "!", "'s", "\xa0", "é", "\t", "\0"]) for _ in range(RNG.randint(0, 14))) for _ in range(800)]
    texts += ["".join(RNG.choice(["on ", "the", " a", "\u2003", "\u3000", "\x85", " é", "\x1c", "\u1680x", " <|endoftext|>", "  "]) for _ in range(RNG.randint(0, 20))) for _ in range(800)]
    for _ in range(4):  # with nothing, some and much remembered
        RNG.shuffle(texts)
        ids, to = encoder.encode(texts)
        for k, t in enumerate(texts):
            assert list(ids[to[k] : to[k + 1]]) == [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
    monkeypatch.setattr(tokenfiles, "LEARNED", 50)
    monkeypatch.setattr(tokenfiles, "CACHE_WORDS", 200)
    for a in range(0, len(texts), 100):
        ids, to = encoder.encode(texts[a : a + 100], 7)
        assert all(list(ids[to[k] : to[k + 1]]) == [*tokenizer.encode(t, add_special_tokens=False).ids, 7] for k, t in enumerate(texts[a : a + 100]))
    assert len(encoder.known) and encoder.encode([])[1].tolist() == [0] and encoder.encode(["", None])[0].tolist() == [0, 0]


def test_chunk_encoder_knows_words_before_any_stop():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    encoder, given = tokenfiles.ChunkEncoder(tokenizer), []
    unknown = encoder._unknown
    encoder._unknown = lambda data, starts, ends, joins: given.extend(data[a:b] for a, b in zip(starts, ends, strict=True)) or unknown(data, starts, ends, joins)
    words = ["".join(RNG.choice("abcdeéß") for _ in range(8)) + "z" for _ in range(200)]
    encoder.encode(["x " + " ".join(words)])
    assert len(given) == 201
    given.clear()
    text = "x " + " ".join(w + RNG.choice(".,!?$&") for w in words)
    ids, _ = encoder.encode([text])
    assert [*ids[:-1]] == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(given) <= 6  # the stops alone
    parts = [" ", "\n", "a", "Z", "7", "é", "×", "÷", "e\u0301", "’", "…", "'s", "'", ".", "!?", "|", "<", "<|endoftext|>", "\r\n", " \n", "\n\n", "東", "\u00a0", "/", "_"]
    texts = ["".join(RNG.choice(parts) for _ in range(RNG.randint(0, 25))) for _ in range(3000)]
    for special_as_text in (False, True):
        tokenizer.encode_special_tokens = special_as_text
        encoder = tokenfiles.ChunkEncoder(tokenizer)
        for a in (0, 0, 1500):
            ids, to = encoder.encode(texts[a:])
            assert all([*ids[to[k] : to[k + 1] - 1]] == tokenizer.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts[a:]))


@pytest.mark.parametrize("as_text", [False, True])
def test_token_rows_equal_a_plain_loop(spark, as_text):
    from tokenizers import Tokenizer

    rows = [(i, " ".join(RNG.choice(["on", "<|endoftext|>", "it's", "a<|endoftext|>b", "é", "12"]) for _ in range(RNG.randint(0, 40)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "long " * 400_000), (102, "again"), (-5, "first")]
    tokenizer, start, want = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json"), 0, {}
    tokenizer.encode_special_tokens = as_text
    for i, text in sorted(rows[:-2] + rows[-1:]):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    df = docs_frame(spark, rows).withColumn("start", F.lit("clash"))
    got = tokenfiles.round_trip(df.where("text <> 'again' or text is null"), f"{TOKENIZERS}/byte_bpe_50k.json", special_as_text=as_text).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == want
    repeated = tokenfiles.round_trip(df, f"{TOKENIZERS}/byte_bpe_50k.json", special_as_text=as_text).collect()
    assert len(repeated) == len(rows) and sum(r["doc_id"] == 102 for r in repeated) == 2
    assert tokenfiles.round_trip(df.limit(0), f"{TOKENIZERS}/byte_bpe_50k.json").count() == 0


def test_token_files_round_trip_and_random_access(spark, tmp_path):
    rows = [(i, " ".join(f"word{RNG.randint(0, 50)}" for _ in range(RNG.randint(0, 300)))) for i in range(150)] + [(500, None), (7, "again"), (None, "x")]
    RNG.shuffle(rows)
    folder = f"file://{tmp_path}/tokens"
    files = tokenfiles.write_token_files(docs_frame(spark, rows), f"{TOKENIZERS}/byte_bpe_50k.json", folder)
    got = sorted(tokenfiles.read_token_files(files, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] is None for r in got].index(True) == 0 and [r["doc_id"] for r in got[1:]] == sorted(i for i, _ in rows if i is not None)
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:], strict=False))
    path = files.first()["path"]
    with open(path, "rb") as f:
        reader = tokenfiles.FrameReader(f, __import__("os").path.getsize(path))
        scanned = list(reader.scan())
        assert all(np.array_equal(reader.read(k), ids) for k, (_, ids) in enumerate(scanned))
    data = bytearray(open(path, "rb").read())
    data[20] ^= 1
    broken = __import__("io").BytesIO(bytes(data))
    with pytest.raises(Exception):
        list(tokenfiles.FrameReader(broken, len(data)).scan())


def test_gumbel_paths_have_their_exact_chances():
    vocabulary = segment.Vocabulary(f"{TOKENIZERS}/piece_bpe_32k.model")
    n = 12000
    data, offsets = textcore.utf8(pa.array(["on"] * n))
    sampler = segment.Sampler(vocabulary, data, offsets, textcore.mix(np.arange(n, dtype=np.uint64)))
    paths, kappa = sampler.sample(2)
    found = [[tuple(ids[a:b].tolist()) for a, b in zip(to[:-1], to[1:], strict=True)] for ids, to in (sampler.ids(e) for e, _, _ in paths)]
    weight = {}
    for ids in set(found[0]) | set(found[1]):
        assert b"".join(vocabulary.pieces[i] for i in ids) == b" on"
        weight[ids] = math.exp(sum(vocabulary.log_p[i] for i in ids))
    total = sum(weight.values())
    first, second = Counter(found[0]), Counter(zip(*found, strict=True))
    assert all(a != b for a, b in zip(*found, strict=True))
    for ids, w in weight.items():
        assert abs(first[ids] / n - w / total) < 0.02
        for other, v in weight.items():
            if other != ids:
                assert abs(second[ids, other] / n - w / total * v / (total - w)) < 0.02
    estimate = sum(np.exp(lp) / -np.expm1(-np.exp(lp - kappa)) for _, lp, _ in paths)
    assert abs(estimate.mean() - 1) < 0.03


def test_lattices_of_parts_stay_and_give_whole_texts_their_mass(monkeypatch):
    vocabulary = segment.Vocabulary(f"{TOKENIZERS}/piece_bpe_32k.model")
    single = {p for p in vocabulary.pieces if p}
    parts = ["on", "The", " ", "  ", ".", ",%%%", "!!", ".\n", "é", "ß", "漢", "\U0001f600", "3", "'s", "▁", "://", "x" * 30, "\x01", "\u0301", "$$$"]
    texts = [s for s in ("".join(RNG.choice(parts) for _ in range(RNG.randint(1, 9))) for _ in range(300)) if s]

    def log_mass(raw):
        ways = [-math.inf] * len(raw) + [0.0]
        for a in range(len(raw) - 1, -1, -1):
            char = max(k for k in range(a + 1) if raw[k] & 0xC0 != 0x80)
            letter = raw[char:].decode()[0].encode()
            edges = [vocabulary.log_p[i] + ways[a + len(p)] for p, i in found(raw, a)] if char == a else []
            edges += [] if letter in usable else [vocabulary.log_p[vocabulary.byte_id[raw[a]]] + ways[a + 1]]
            ways[a] = float(np.logaddexp.reduce(edges)) if edges else -math.inf
        return ways[0]

    usable = {p: i for i, p in enumerate(vocabulary.pieces) if p in single and i not in set(vocabulary.byte_id.tolist()) and vocabulary.log_p[i] > -np.inf}
    longest = max(map(len, usable))
    found = lambda raw, a: [(raw[a:b], usable[raw[a:b]]) for b in range(a + 1, min(len(raw), a + longest) + 1) if raw[a:b] in usable]
    held, built = segment.Lattice(vocabulary), []
    build = held._build
    held._build = lambda data, starts, ends: built.append(len(starts)) or build(data, starts, ends)
    data, offsets = textcore.utf8(pa.array(texts))
    seeds = textcore.mix(np.arange(len(texts), dtype=np.uint64))
    drawn = []
    for lattice in (None, held, held, held):
        sampler = segment.Sampler(vocabulary, data, offsets, seeds, lattice)
        paths, _ = sampler.sample(3)
        drawn.append([[x.tolist() for x in sampler.ids(edges)] for edges, _, _ in paths])
        for edges, log_p, gumbel in paths:
            ids, to = sampler.ids(edges)
            for k in np.flatnonzero(gumbel > -np.inf)[:60]:
                want = vocabulary.log_p[ids[to[k] : to[k + 1]]].sum() - log_mass(b" " + texts[k].encode())
                assert abs(log_p[k] - want) < 1e-8
    assert drawn[0] == drawn[1] == drawn[2] == drawn[3] and built[0] == built[1] > 0 == built[2]
    held._build = build
    monkeypatch.setattr(segment, "KEPT", 500)
    for a in range(0, len(texts), 20):
        data, offsets = textcore.utf8(pa.array(texts[a : a + 20]))
        sampler = segment.Sampler(vocabulary, data, offsets, seeds[a : a + 20], held)
        some = [[x.tolist() for x in sampler.ids(edges)] for edges, _, _ in sampler.sample(3)[0]]
        assert all(ids == [i for k in range(a, min(a + 20, len(texts))) for i in whole[to[k] : to[k + 1]]] for (ids, _), (whole, to) in zip(some, drawn[0], strict=True))
    words = [f"{w}{stop}" for stop in (",", ".", "!!") for w in ("onion", "there")]
    data, offsets = textcore.utf8(pa.array([" ".join(words)]))
    assert len(np.unique(segment.Sampler(vocabulary, data, offsets, seeds[:1]).roots)) == 5


def test_segmentations_decode_and_repeat(spark):
    model = f"{TOKENIZERS}/piece_bpe_32k.model"
    rows = [(1, "  two  spaces\nă▁ 漢字 end "), (2, None), (3, ""), (4, "x" * 3000), (5, "a b " * 500), (1, "  two  spaces\nă▁ 漢字 end ")]
    a = segment.sample_segmentations(docs_frame(spark, rows), model, k=3).collect()
    b = segment.sample_segmentations(docs_frame(spark, rows).repartition(3), model, k=3).collect()
    told = lambda r: (r["doc_id"] or 0, r["n_bytes"], [(p["ids"], round(p["log_prob"], 6), round(p["log_inclusion"], 6)) for p in r["paths"]])
    assert sorted(map(told, a)) == sorted(map(told, b))
    for r in a:
        assert all(p["decodes"] for p in r["paths"]) and len({tuple(p["ids"]) for p in r["paths"]}) == len(r["paths"])
        assert len(r["paths"]) == (3 if r["n_bytes"] else 0)
    texts = {r["doc_id"]: r["text"] for r in segment.decoded(segment.encode(docs_frame(spark, [(9, "plain text é"), (8, "")]), model), model).collect()}
    assert texts == {9: "plain text é", 8: ""}


def test_segmentations_of_odd_tables(spark):
    model = f"{TOKENIZERS}/piece_bpe_32k.model"
    df = spark.createDataFrame([(None, "a b", 1), (1, "word " * 120_000, 2), (2, None, 3)], "doc_id long, text string, paths int")
    got = segment.digest(segment.sample_segmentations(df, model, with_ids=False)).collect()
    assert sorted((r["doc_id"] or 0, r["n_paths"], r["decodes"]) for r in got) == [(0, 2, True), (1, 2, True), (2, 0, True)]
    assert segment.sample_segmentations(df.limit(0), model).count() == 0


def brute_pipeline(rows, words=5):
    """The first and third stage by plain loops, on documents that no toxicity stage drops."""
    kept = []
    for i, t in rows:
        w = __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        longer = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if longer[tuple(w[k : k + 8])] > 1 for j in range(8)}
        longest = max(brute_repeats(w), default=0)
        if len(w) >= 50 and 2 * len(repeated) <= len(w) and sum(len(w[k]) for k in covered) <= 0.3 * sum(map(len, w)) and longest <= 100:
            kept.append((i, t))
    sets = {i: shingle_set(t, words) for i, t in kept}
    edges = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = components_of(sets, edges)
    return [i for i, _ in kept], sorted(i for i in sets if label[i] == i)


def test_pipeline_matches_a_plain_version_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    word = lambda: RNG.choice("abcdefgh") + str(RNG.randint(0, 60))
    texts = []
    for k in range(40):
        w = [word() for _ in range(RNG.randint(40, 90))]
        texts.append(" ".join(w))
        if k % 4 == 0:
            w[3] = "changed"
            texts.append(" ".join(w))
        if k % 7 == 0:
            texts.append(" ".join(w + w[:30]))
    texts += [None, "", "short", texts[0]]
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", None, "extra") for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _m string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    first, third = brute_pipeline([(i, t) for i, t, *_ in rows])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    judged = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in judged.collect()) == first and judged.columns == docs.columns
    left = corpus_pipeline.STAGES[2][1](spark, corpus_pipeline.STAGES[1][1](spark, judged, str(tmp_path)), str(tmp_path))
    assert sorted(r["doc_id"] for r in left.collect()) == third
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} <= set(third) and all(p["decodes"] for r in out for p in r["paths"])
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    filler = [a + b for a in ("th", "er", "on", "st") for b in ("an", "in", "or", "ed", "es")]
    clean = [" ".join(RNG.choice(filler) + str(RNG.randint(0, 60)) for _ in range(RNG.randint(60, 120))) for _ in range(80)]
    bad = [" ".join(["buy now cheap pills here today only for you my friend"] * 12), "too short"]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate([*clean, *bad, clean[0], clean[1]])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert sorted(r["doc_id"] for r in docs.collect()) == list(range(80))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} <= set(range(80)) and all(len(r["paths"]) == 2 for r in out)


def test_audits_have_links_and_widen_the_beam():
    rng = np.random.default_rng(4)
    apart = rng.normal(size=(500, 24)).astype(np.float32)  # none of them are linked
    graph = hnsw.Graph.loads(hnsw.Graph(np.arange(500) * 7919, np.ones(500, np.int64), apart).dumps())
    queries = hnsw.Queries(np.arange(500) * 7919, apart)
    found = graph.audited_links(queries, 0.9, 8, 16, 0.999)
    assert found.count.sum() == 0 and found.audit[0] >= 16 and found.audit[1] >= 0.999 * found.audit[0]
    sure = graph.planted(16, 0.9)
    row, place = graph.exact(sure, 0.9)
    assert set(row.tolist()) == set(range(16)) and not set(sure.ids.tolist()) & set(graph.ids.tolist())
    # a beam of one loses links of scattered pairs; the audit must notice and widen it
    base = rng.normal(size=(1000, 24))
    pairs = np.concatenate([base, base + 0.1 * rng.normal(size=base.shape)]).astype(np.float32)
    ids = np.arange(len(pairs)) * 104729
    graph, queries = hnsw.Graph.loads(hnsw.Graph(ids, np.ones(len(ids), np.int64), pairs).dumps()), hnsw.Queries(ids, pairs)
    truth = len(graph.exact(queries, 0.9)[0])
    narrow = sum(len(r) for r, _ in graph.links(queries, 0.9, 1))
    wide = graph.audited_links(queries, 0.9, 1, 500, 0.999)
    assert narrow < 0.99 * truth < 0.995 * truth <= wide.count.sum() and wide.audit[1] >= 0.999 * wide.audit[0]
    one = hnsw.Graph.loads(hnsw.Graph(np.array([5]), np.ones(1, np.int64), np.ones((1, 1), np.float32)).dumps())
    assert one.audited_links(hnsw.Queries(np.array([5]), np.ones((1, 1), np.float32)), 0.9, 4, 8, 0.999).audit.tolist() == [1, 1]


@pytest.mark.parametrize("links", [0, 40])
def test_recall_is_measured_with_and_without_links(spark, links):
    rng = np.random.default_rng(links)
    vectors = rng.normal(size=(1500, 24))
    copies = vectors[:links] + 0.02 * rng.normal(size=(links, 24))
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(np.concatenate([vectors, copies]))], "vec_id long, embedding array<double>")
    got = hnsw.link_embeddings(df, with_recall=True, shards=3).collect()
    assert {r["audit_recall"] is not None and r["audit_recall"] >= 0.999 for r in got} == {True}
    assert sum(r["n_links"] for r in got) == 2 * links
