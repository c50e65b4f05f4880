import io
import zipfile

import numpy as np
from pyspark.sql import functions as F

from gridloom.functions import scalars as S
from gridloom.operators import binning, islands, metrics, text, vocab
from gridloom.sources import readers, sinks
from gridloom.streaming import stream


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_strip_takes_separator_controls_and_unicode_blanks(spark):
    assert one(spark, "\x1c  a b \x1f\n", S.strip) == "a b"


def test_normalise_code(spark):
    assert [one(spark, v, S.normalise_code) for v in ("3130.0", " 7 ", "A1", "2.5", None)] == ["3130", "7", "A1", "2.5", None]


def test_clean_order_and_nulls(spark):
    assert one(spark, "a &lt;b&gt; <i>c</i>\u200b\t d\n\n\n e", text.clean) == "a c d\n\ne"
    assert one(spark, None, text.clean) is None


def test_first_failing_rule(spark):
    rule = lambda x: text.filter_reason(x, 3, 10, 0.5, 0.3)
    assert [one(spark, v, rule) for v in ("a", "abcdefghijkl", "12345", "ab\nab\ncd", "abcde")] == ["min_chars", "max_chars", "alpha_ratio", "repeated_lines", None]


def test_exact_and_keyed_dedup(spark):
    df = spark.createDataFrame([(2, " A "), (1, "a"), (3, "b")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in text.exact_dedup(df, ["doc_id"]).collect()) == [1, 3]
    k = spark.createDataFrame([("x", 1, 0), ("x", 2, 1), ("x", 2, 2), (None, 1, 3), (None, 1, 4)], "k string, day int, pos int")
    assert sorted(r["pos"] for r in text.keyed_dedup(k, F.col("k"), [F.col("day"), F.col("pos")]).collect()) == [2, 3, 4]


def test_versions_of_masks_and_tags(spark):
    rows = [(1, "Serial number 8812349900"), (2, "call 555 123 4567 or (0123) 456 7890"), (3, "+44 1234 567890"), (4, "<EMAIL> stays; x@y.io <EMAIL>"), (5, "12345678 and 99"), (6, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    v1 = {r["id"]: r for r in text.mask_pii(df, phone="v1", digits=True).collect()}
    assert v1[1]["text"] == "Serial number <NUMBER>" and (v1[1]["n_phone"], v1[1]["n_digits"]) == (0, 1)
    assert v1[2]["text"] == "call <PHONE> or <PHONE>" and v1[3]["text"] == "<PHONE>" and v1[2]["n_phone"] == 2
    assert v1[4]["text"] == "<EMAIL> stays; <EMAIL> <EMAIL>" and v1[4]["n_email"] == 1 and v1[5]["n_digits"] == 1 and v1[6]["text"] is None
    v0 = {r["id"]: r["text"] for r in text.mask_pii(df).collect()}
    assert v0[1] == "Serial number <PHONE>" and v0[5] == "12345678 and 99"
    tags = spark.createDataFrame([("Wind < start wind and more > less",), ("<b class='x'>a</b><!-- c\nd --><br/>",)], "t string")
    out = [[r[0].strip() for r in tags.select(text.remove_tags(tags.t, v)).collect()] for v in ("v0", "v1")]
    assert out[0] == ["Wind   less", "a"] and out[1] == ["Wind < start wind and more > less", "a"]


def test_masks_in_sequence(spark):
    df = spark.createDataFrame([("mail a.b@c.org or +1 (252) 555-8630",)], "text string")
    row = text.mask_pii(df).first()
    assert (row["text"], row["n_email"], row["n_phone"]) == ("mail <EMAIL> or <PHONE>", 1, 1)


def test_shingle_pairs_find_what_all_pairs_find(spark):
    rng = np.random.default_rng(0)
    base = [f"w{k}" for k in rng.integers(0, 40, 60)]
    docs = [(0, " ".join(base))]
    for n in range(1, 12):
        words = list(base)
        for k in rng.integers(0, 60, n // 2):
            words[k] = f"x{n}"
        docs.append((n, " ".join(words)))
    grams = {i: {tuple(t.split()[a : a + 3]) for a in range(58)} for i, t in docs}
    want = sorted((a, b) for a in grams for b in grams if a < b and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) > 0.6)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((r["a"], r["b"]) for r in vocab.shingle_pairs(df, 3, 0.6).collect()) == want


def test_shingle_pairs_of_copies_and_common_passages(spark):
    rng = np.random.default_rng(1)
    common = [f"c{k}" for k in range(30)]
    docs = [(100, None), (101, " "), (102, "Two words"), (103, "two\twords")]
    for n in range(40):
        own = [f"o{n % 13}_{k}" for k in range(20 + n % 13)]
        for k in rng.integers(0, len(own), n // 13):
            own[k] = f"x{n}"
        docs.append((n, " ".join(common[: n % 31] + own)))
    docs += [(n + 50, t.upper()) for n, t in docs[4:44:3]] + [(n + 110, "  " + t) for n, t in docs[4:20:3]]
    rows = {i: t.lower().split() for i, t in docs if t}
    grams = {i: {tuple(w[a : a + 3]) for a in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} for i, w in rows.items() if w}
    want = {(a, b): len(grams[a] & grams[b]) / len(grams[a] | grams[b]) for a in grams for b in grams if a < b}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for above, one_in, at_least in ((0.8, 16, 4), (0.6, 1, 2), (0.3, 1, 5)):
        got = {(r["a"], r["b"]): r["jaccard"] for r in vocab.shingle_pairs(df, 3, above, one_in, at_least).collect()}
        assert got == {p: j for p, j in want.items() if j > above} and len(got) > 20


def test_shingle_pairs_shuffle_less_than_the_texts(spark):
    rng = np.random.default_rng(2)
    docs = [(n, " ".join(f"word{k}" for k in rng.integers(0, 10**6, 400))) for n in range(300)] + [(300, "word1 " * 50)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = shuffled()
    assert vocab.shingle_pairs(df, 5, 0.8).count() == 0
    assert shuffled() - before < sum(len(t) for _, t in docs) / 2


def test_byte_pairs_break_ties_by_the_smallest_pair():
    pairs = vocab.BytePairs.from_pretokens({"abab": 1, "cd": 2}, 2)
    assert pairs.merges == [(97, 98), (99, 100)]
    assert pairs.decode(pairs.encode("abab cd é")) == "abab cd é"


def test_byte_pairs_count_rare_pretokens(spark):
    texts = [f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)} " * 2 for k in range(2100)]
    texts += ["xy" + chr(0x4E00 + k) for k in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    got = {r["item_id"]: len(r["ids"]) for r in vocab.encode_texts(df, vocab.fit_byte_pairs(df, 100)).collect()}
    assert len(got) == 5100 and got[2100] < 5  # x and y are merged, in pretokens that occur once


def test_bins_and_ids(spark):
    df = spark.createDataFrame([(v,) for v in (0.5, 1.0, 2.5, None, float("nan"))], "v double")
    edges = F.array(F.lit(1.0), F.lit(2.0))
    assert [r["b"] for r in df.select(binning.bin_of(F.col("v"), edges).alias("b")).collect()] == [0, 1, 2, -1, -1]
    assert binning.offset_of("text") == 1184


def test_average_precision_with_ties(spark):
    data = [(0.9, 1), (0.9, 0), (0.5, 1), (0.1, 0)]
    df = spark.createDataFrame(data, "score double, label int")
    assert abs(metrics.average_precision(df).first()["ap"] - (0.5 * 0.5 + 0.5 * (2 / 3))) < 1e-12
    none = metrics.average_precision(df.where("label = 0")).first()
    assert none["ap"] is None


def test_curve_area_by_weights(spark):
    errors = [0, 1, 0, 0, 1]
    df = spark.createDataFrame([(k, 1.0 - k / 10, e) for k, e in enumerate(errors)], "id int, confidence double, error int")
    area = metrics.aurc(df, [], "id").first()["aurc"]
    assert abs(area - (metrics.harmonic_weights(5) * np.array(errors)).sum()) < 1e-12


def test_platt_recovers_a_logistic(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=4000)
    y = rng.random(4000) < 1 / (1 + np.exp(-(2 * x - 1)))
    a, b = metrics.fit_platt(spark.createDataFrame([(float(u), int(v)) for u, v in zip(x, y, strict=True)], "logit double, label int"))
    assert abs(a - 2) < 0.2 and abs(b + 1) < 0.15


def test_balanced_shift(spark):
    df = spark.createDataFrame([(float(k) / 10,) for k in range(-30, 31)], "z double")
    c = metrics.balanced_shift(df, "z", 0.2)
    assert abs(df.select(F.avg(S.sigmoid(F.col("z") + c))).first()[0] - 0.2) < 1e-3


def test_commented_csv_and_zip(spark, tmp_path):
    file = tmp_path / "a.csv"
    file.write_text("# Turbine: K1\n# Date and time,Wind, speed\n".replace("Wind, speed", "Wind") + "2020-01-01,5.5\n2020-01-02,\n")
    skip, header, sep = readers.sniff_csv(file.read_text())
    assert (skip, header, sep) == (2, ["Date and time", "Wind"], ",")
    assert readers.preamble(file.read_text())["Turbine"] == "K1"
    df = readers.read_commented_csv(spark, str(file), ["Wind", "absent"])
    assert df.columns == ["Wind"] and [r[0] for r in df.collect()] == ["5.5", None]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("x.csv", "a\n1\n")
        z.writestr("y.bin", "no")
    (tmp_path / "z.zip").write_bytes(data.getvalue())
    assert [r["member"] for r in readers.read_zip_members(spark, str(tmp_path)).collect()] == ["x.csv"]


def test_json_lines_sink_counts(spark, tmp_path):
    assert sinks.write_json_lines(spark.range(7), str(tmp_path / "out")) == 7


def test_windowed_stream(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:01:00", 2.0), (1, "2024-01-01 00:09:00", 4.0)], "k int, t string, v double").selectExpr("k", "cast(t as timestamp) t", "v").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k int, t timestamp, v double").parquet(str(tmp_path / "in"))
    out = stream.run_once(stream.windowed_stats(source, "t", ["k"], "v"), "w", "complete").collect()
    assert [(r["n"], r["mean"]) for r in out] == [(2, 3.0)]


def test_entry_point_queries_have_names_for_their_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_decisions():
    from gridloom.operators import decisions as D

    sure, loose = D.Interval(0.1, 0.4), D.Interval(0.1, 0.4, discarded=0.2)
    assert [D.position(sure, x) for x in (0.05, 0.2, 0.5)] == ["clears", "contains", "below"] and D.position(loose, 0.05) == "contains"
    assert D.all_positive([sure, sure]) == (True, 0.1) and not D.all_positive([sure, loose])[0]
    assert D.supported([sure], [0.2, 0.3, 0.4], 0.0, 0.25, 0.0) == "supported" and D.supported([sure], [0.1], 0.2, 0.2, 0.5) == "refuted"
    assert D.gate(loose, 1, "damage") == "untrusted" and D.gate(sure, 0.3, "damage") == "damage" and D.gate(sure, 0.5, "damage") == "pass"
    assert [D.move(*x, 5) for x in ((0, 0), (0, 3), (3, 6), (6, 3), (6, 7))] == ["absent", "appears", "rises", "falls", "stays"]
    assert D.disjoint({"a": (0, 3), "b": (3, 5)}) and not D.disjoint({"a": (0, 4), "b": (3, 5)})


def test_token_arrays(spark):
    from gridloom.operators import tokens as N

    df = spark.createDataFrame([([1, 7, 5, 8, 1, 7, 8],), ([7, 7, 8, 8],), ([8, 7],), ([],)], "t array<int>")
    spans = [r["s"] for r in df.select(N.message_spans(F.col("t"), 7, 8).alias("s")).collect()]
    assert [(p["a"], p["b"]) for p in spans[0]] == [(1, 3), (5, 6)] and spans[1] is None and spans[2] is None and spans[3] == []
    assert df.limit(1).select(N.drop_spans(F.col("t"), N.message_spans(F.col("t"), 7, 8)).alias("x")).first()["x"] == [1, 1]


def test_mixture_schedule_keeps_shares():
    from gridloom.operators.samplers import mixture_schedule

    drawn = mixture_schedule({"a": 0.5, "b": 0.25, "c": 0.25}, 8)
    assert drawn[0] == "a" and (drawn.count("a"), drawn.count("b"), drawn.count("c")) == (4, 2, 2)


def test_channel_edges_with_masses_and_tails(spark):
    values = [0.0] * 50 + [k / 10 for k in range(1, 151)]
    edges = binning.fit_channel(spark.createDataFrame([(v,) for v in values], "v double"), "v", 10, tail=0.05, tail_bins=2, floor=3)
    assert edges == sorted(set(edges)) and len(edges) < 14
    assert binning.merge_outward([1.0, 2.0, 3.0], [1, 1, 5, 9], 3) == [3.0]
    assert binning.merge_outward([1.0, 2.0, 3.0], [4, 5, 2, 0], 3) == [1.0]


def weighted(values):
    found, counts = np.unique(np.asarray(values, float), return_counts=True)
    return binning.Counted(found, counts)


def occupancy(edges, values):
    return np.bincount(np.clip(np.searchsorted(np.asarray(edges)[1:-1], values, side="right"), 0, len(edges) - 2), minlength=len(edges) - 1)


def heavy_tailed(seed=5):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(60, 3, 30_000), rng.normal(95, 12, 300)])


def test_plain_bins_are_linear_quantiles():
    values = heavy_tailed()
    laid = binning.lay_bins(weighted(values), binning.BinRule(16))
    assert np.allclose(laid["edges"], np.quantile(values, np.linspace(0, 1, 17))) and laid["masses"] == []
    assert np.allclose(laid["reps"], (np.array(laid["edges"])[1:] + np.array(laid["edges"])[:-1]) / 2)


def test_tails_have_equal_widths_and_the_whole_budget_is_spent():
    values = heavy_tailed()
    laid = binning.lay_bins(weighted(values), binning.BinRule(64, True, None, 8))
    edges = np.array(laid["edges"])
    assert len(edges) == 65 and (laid["lower_bins"], laid["upper_bins"]) == (8, 8)
    assert np.allclose(np.diff(edges[:9]), edges[1] - edges[0]) and np.allclose(np.diff(edges[-9:]), edges[-1] - edges[-2])
    assert np.allclose([laid["tail_low"], laid["tail_high"]], np.quantile(values, [0.005, 0.995]))


def test_the_floor_joins_outer_bins_and_spares_the_middle():
    values, floor = heavy_tailed(), 0.001
    held = occupancy(binning.lay_bins(weighted(values), binning.BinRule(64, True, None, 8, floor=floor))["edges"], values)
    assert min(held[0], held[-1]) >= np.ceil(floor * len(values))
    greedy = binning.lay_bins(weighted(values), binning.BinRule(64, True, None, 8, floor=0.4))
    assert (greedy["lower_bins"], greedy["upper_bins"], greedy["lower_merged"], greedy["upper_merged"]) == (1, 1, 7, 7)


def test_masses_keep_their_bins():
    rng = np.random.default_rng(2)
    values = np.concatenate([np.linspace(0, 0.4, 210), np.full(790, 0.45), rng.uniform(0.5, 100, 199_000)])
    laid = binning.lay_bins(weighted(values), binning.BinRule(256, True, None, 4, floor=0.001))
    held = occupancy(laid["edges"], values)
    assert laid["masses"] == [0.45] and list(held[:2]) == [210, 790] and laid["lower_merged"] == 3 and laid["reps"][1] == 0.45
    zeros = binning.lay_bins(weighted([0.0] * 5000 + list(np.linspace(0.1, 50, 5000))), binning.BinRule(64, True, None, 8))
    assert (zeros["lower_bins"], zeros["upper_bins"], zeros["masses"], len(zeros["edges"])) == (0, 8, [0.0], 65)


def test_bins_fitted_applied_and_inverted(spark):
    values = heavy_tailed()[:4000]
    rows = [("a", float(v)) for v in values] + [("b", float(k % 7)) for k in range(700)] + [("a", None), ("a", float("nan")), ("b", float("inf"))]
    df = spark.createDataFrame(rows, "channel string, value double")
    fitted = binning.fit_bins(df, binning.BinRule(32, True, None, 4))
    want = binning.lay_bins(weighted(values), binning.BinRule(32, True, None, 4))
    got = {r["channel"]: r for r in fitted.collect()}
    assert set(got) == {"a", "b"} and np.allclose(got["a"]["edges"], want["edges"])
    wide = spark.createDataFrame([(60.0, 3.0), (-1e9, None), (1e9, float("nan"))], "a double, b double")
    bins = [tuple(r) for r in binning.transform(wide, ["a", "b", "c"], fitted).select("a__bin", "b__bin", "c__bin").collect()]
    assert bins[1][0] == 0 and bins[2][0] == len(want["reps"]) - 1 and [b[1] for b in bins[1:]] == [-1, -1] and all(b[2] == -1 for b in bins)
    back = binning.inverse(spark.createDataFrame([("b", bins[0][1]), ("b", -1), ("a", 10**6)], "channel string, bin int"), fitted).collect()
    assert back[0]["value"] == 3.0 and back[1]["value"] is None and abs(back[2]["value"] - want["reps"][-1]) < 1e-9
    split = df.withColumn("split", F.lit("train"))
    fit = {r["channel"]: r for r in binning.bin_fit(split, fitted).collect()}
    assert fit["b"]["error"] == 0 and fit["b"]["mass_share"] == 1 and fit["a"]["relative_error"] < 0.2 and fit["a"]["n"] == 4000
    tails = binning.tail_occupancy(df, fitted).where("channel = 'a'").collect()
    assert len(tails) == 8 and sum(r["n"] for r in tails) >= 36
    beyond = binning.out_of_range(df.withColumn("value", F.col("value") + 1000), fitted.where("channel = 'a'"), []).first()
    assert beyond["above"] == beyond["n"] == 4000
    some = binning.fit_bins(df, binning.BinRule(8), sample_rows=500).where("channel = 'a'").first()
    assert abs(some["edges"][4] - np.median(values)) < 1


def test_a_year_of_one_key_is_imputed_and_segmented_in_linear_time(spark):
    import time

    n = 52_560
    df = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 600).alias("t"), F.when(F.col("id") % 11 != 5, F.col("id").cast("double")).alias("v"))
    start = time.time()
    got = islands.impute(df, ["k"], "t", "v").where("v__imputed").agg(F.count("*"), F.sum(F.abs(F.col("v") - F.col("t") / 600))).first()
    segments = islands.segments(df, ["k"], "t", F.col("v").isNotNull(), 3600).agg(F.count_distinct("segment_id")).first()
    assert got[0] == sum(k % 11 == 5 for k in range(n)) and got[1] < 1e-6 and segments[0] == 1
    assert time.time() - start < 30
