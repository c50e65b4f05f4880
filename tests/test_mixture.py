"""Digests of token streams, and a mixture of readings, messages and text from tables to files."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import mixture as M
from gridloom.operators import shards as H


def plain_digest(tokens):
    return "".join(f"{sum((t + 1) * pow(b, i, m) for i, t in enumerate(tokens)) % m:08x}" for b, m in zip(M.BASES, M.MODULI, strict=True))


def cut(tokens, at):
    bounds = [0, *sorted(at), len(tokens)]
    return [(a, tokens[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]


def chunks(spark, streams, cuts):
    rows = [(k, at, ids) for k, t in streams.items() for at, ids in cut(t, [c for c in cuts if c < len(t)])]
    return spark.createDataFrame(rows, "k string, at long, ids array<int>").repartition(3)


def test_digests_don_t_depend_on_cuts_and_find_one_changed_token(spark):
    rng = random.Random(4)
    streams = {"a": [rng.randrange(40_000) for _ in range(3000)], "b": [5], "c": [0] * 50, "d": []}
    want = {k: (len(t), plain_digest(t)) for k, t in streams.items()}
    for cuts in ([], [1, 700, 701, 2500], list(range(0, 3000, 97))):
        got = {r["k"]: (r["tokens"], r["digest"]) for r in M.stream_digests(chunks(spark, streams, cuts), ["k"]).collect()}
        assert got == want
    changed = {**streams, "a": [*streams["a"][:1500], streams["a"][1500] + 1, *streams["a"][1501:]], "c": [0] * 51}
    got = {r["k"]: (r["tokens"], r["digest"]) for r in M.stream_digests(chunks(spark, changed, [9]), ["k"]).collect()}
    assert [k for k in want if got[k] != want[k]] == ["a", "c"]
    far = spark.createDataFrame([("x", 2**40 + 3, [7])], "k string, at long, ids array<int>")
    want_far = "".join(f"{8 * pow(b, 2**40 + 3, m) % m:08x}" for b, m in zip(M.BASES, M.MODULI, strict=True))
    assert M.stream_digests(far, ["k"]).first()["digest"] == want_far


def test_differing_chunks_and_prefixes(spark):
    tokens = list(range(100))
    as_chunks = lambda t, size=10: spark.createDataFrame([("s", c // size, c, t[c : c + size]) for c in range(0, len(t), size)], "k string, chunk long, at long, ids array<int>")
    other = [*tokens[:37], 999, *tokens[38:]]
    assert [r["chunk"] for r in M.differing_chunks(as_chunks(tokens), as_chunks(other), ["k"]).collect()] == [3]
    assert sorted(r["chunk"] for r in M.differing_chunks(as_chunks(tokens), as_chunks(tokens[:75]), ["k"]).collect()) == [7, 8, 9]
    assert M.differing_chunks(as_chunks(tokens), as_chunks(tokens), ["k"]).count() == 0
    head = lambda t: spark.createDataFrame([("s", 0, t[:20]), ("s", 20, t[20:35])], "k string, at long, ids array<int>")
    assert M.same_prefix(head(tokens), as_chunks(tokens), ["k"]).first()["same"]
    assert M.same_prefix(head(tokens), as_chunks(other), ["k"]).first()["same"]  # the change lies behind it
    assert not M.same_prefix(head(other), as_chunks(tokens[:20]), ["k"]).first()["same"]
    assert not M.same_prefix(head([5, *tokens[1:]]), as_chunks(tokens), ["k"]).first()["same"]
    assert M.same_prefix(head(tokens), as_chunks(tokens).where("false"), ["k"]).first()["same"] is False
    high = M.highest_ids(as_chunks(other), ["k"], 100).first()
    assert (high["tokens"], high["highest"], high["inside"]) == (100, 999, False)


def tables(spark):
    rng = random.Random(6)
    steps, messages = [], []
    for turbine in ("t1", "t2", "u1"):
        for segment, first in ((0, 0), (1, 40)):
            for s in range(first, first + 12 + segment):
                split = "train" if s < 46 else "val"
                steps.append(("S" if turbine < "u" else "U", split, turbine, 2020, segment, s * 10, [1, rng.randrange(9), rng.randrange(9)]))
        for _ in range(30):
            messages.append((turbine, rng.randrange(620), rng.choice(["stop", "Go", None, "fault x"])))
    texts = [(f"d{k % 2}", "train", k, [rng.randrange(50) for _ in range(k)] + [99]) for k in range(12)]
    return (
        steps, messages, texts,
        spark.createDataFrame(steps, "source string, split string, turbine string, year int, segment int, step long, ids array<int>"),
        spark.createDataFrame(messages, "turbine string, start long, message string"),
        spark.createDataFrame(texts, "source string, split string, doc long, ids array<int>"),
    )


def letters(change):
    return lambda df: df.withColumn("ids", F.transform(F.filter(F.split(change(F.col("message")), ""), lambda x: x != ""), F.ascii))


def build(spark, path, frames, **more):
    kinds = {"raw": letters(lambda m: m), "lower": letters(F.lower)}
    return M.build_mixture(*frames, path, kinds, step_of=lambda t: F.floor(t / 10) * 10, context=9, stride=2, text_offset=1000, separator=99, joint_separator=7, **more)


def test_a_mixture_is_written_with_runs_and_tallies(spark, tmp_path):
    steps, messages, texts, *frames = tables(spark)
    out = build(spark, f"file://{tmp_path}/mix", frames, speaking=["S"])
    at = {(t, s) for _, _, t, _, _, s, _ in steps}
    said = {}
    for turbine, start, text in messages:
        if text is not None and (turbine, start // 10 * 10) in at:
            said.setdefault((turbine, start // 10 * 10), []).append((start, text))
    streams, runs, tally = {}, {}, {}
    for name, variant, lower in (("tel", "-", None), ("tel+status", "raw", False), ("tel+status", "lower", True)):
        for row in sorted(steps, key=lambda r: (r[0], r[1], r[2], r[4], r[5])):
            source, split, turbine, year, segment, step, ids = row
            if lower is not None and source != "S":
                continue
            mine = sorted(said.get((turbine, step), [])) if lower is not None else []
            more = [ord(c) for _, m in mine for c in (m.lower() if lower else m)]
            stream = streams.setdefault((name, variant, source, split), [])
            run = runs.setdefault((name, variant, source, split, turbine, segment), [len(stream), 0, []])
            run[2].append(run[1])
            run[1] += len(ids) + len(more)
            stream += ids + more
            t = tally.setdefault((name, variant, source, split), [0, 0, 0])
            t[0] += 1
            t[1] += len(mine)
            t[2] += len(more)
    windows = {k: sum(o + 9 <= n for o in offsets[::2]) for k, (_, n, offsets) in runs.items()}
    got = {(r["stream"], r["variant"], r["source"], r["split"], r["turbine"], r["segment"]): r for r in out["runs"].collect()}
    assert {k: (r["first_token"], r["tokens"], r["steps"], r["windows"]) for k, r in got.items()} == {k: (f, n, len(o), windows[k]) for k, (f, n, o) in runs.items()}
    for _, _, _, ids in texts:
        pass
    for source in ("d0", "d1"):
        ids = [x for s, _, _, t in texts if s == source for x in t]
        streams["txt", "-", source, "train"] = [7 if x == 99 else x + 1000 for x in ids]
        tally["txt", "-", source, "train"] = [0, 0, 0]
    want = {k: (len(t), *tally[k], sum(w for r, w in windows.items() if r[:4] == k) if k[0] != "txt" else max(0, len(t) - 8)) for k, t in streams.items()}
    told = {(r["stream"], r["variant"], r["source"], r["split"]): r for r in out["tallies"].collect()}
    assert {k: tuple(r[c] for c in ("tokens", "steps", "messages", "message_tokens", "windows")) for k, r in told.items()} == want
    digests = {}
    for name in ("tel", "tel+status_raw", "tel+status_lower", "txt"):
        for r in M.stream_digests(out[name], M.SHARD).collect():
            stream, _, variant = name.partition("_")
            digests[stream, variant or "-", r["source"], r["split"]] = r["digest"]
    assert digests == {k: plain_digest(t) for k, t in streams.items()}
    lost = out["losses"].first()
    assert lost["unmatched"] == sum(m is None for *_, m in messages) and lost["dropped"] == sum(m is not None for *_, m in messages) - sum(map(len, said.values()))


def test_a_mixture_of_empty_tables(spark, tmp_path):
    *_, steps, messages, texts = tables(spark)
    out = build(spark, f"file://{tmp_path}/none", [df.where("false") for df in (steps, messages, texts)])
    assert out["tallies"].count() == 0 and out["runs"].count() == 0 and out["losses"].first()["dropped"] == 0


def test_shards_are_written_with_their_windows(spark, tmp_path):
    rows = [(s, r, k, [s, r, k]) for s in (0, 1) for r in (0, 1) for k in range(7)]
    steps = H.number_steps(spark.createDataFrame(rows, "site int, run int, step int, ids array<int>"), ["site"], ["run"], "step")
    index = steps.where("step >= 3").select("site", "run", F.col("step_no").alias("end_step"))
    got = {r["site"]: r.asDict() for r in H.write_shards(steps, index, ["site"], "ids", f"file://{tmp_path}/s", 3).collect()}
    assert got[1] == {"site": 1, "steps": 14, "tokens": 42, "bytes": 84, "windows": 8}
    with pytest.raises(ValueError, match="whole"):
        H.write_shards(steps.where("step_no <> 4"), index, ["site"], "ids", f"file://{tmp_path}/t", 3)
    runs = spark.createDataFrame([(0, 5, 10), (0, 7, 2), (1, 1, 4)], "site int, run int, tokens int")
    assert {(r["site"], r["run"]): r["first_token"] for r in H.append_run(runs, ["site"], "run", "tokens").collect()} == {(0, 5): 0, (0, 7): 10, (1, 1): 0}
    starts = H.run_step_starts(steps.withColumn("offset", F.col("step_no") * 3).withColumns({"f": F.col("run") * 21, "n": F.lit(21)}), ["site", "run"], "f", "n", 2, 9)
    assert {(r["site"], r["run"]): r["windows"] for r in H.windows_in_run(starts, ["site", "run"]).collect()} == {(s, r): 3 for s in (0, 1) for r in (0, 1)}
    framed = spark.createDataFrame([(True, 4, False, 0), (True, 8, True, 2), (False, 10, False, 5)], "y boolean, steps_retained int, head_cut boolean, status_tokens int")
    kinds = {r["kind"]: r for r in H.index_statistics(framed, "y", 9).collect()}
    assert kinds["all"]["windows"] == 3 and kinds["positive"]["mean_steps"] == 6 and kinds["positive"]["truncated"] == 1 and kinds["negative"]["with_status"] == 1
    assert kinds["all"]["least_steps"] == 4 and abs(kinds["all"]["cut"] - 1 / 3) < 1e-9
