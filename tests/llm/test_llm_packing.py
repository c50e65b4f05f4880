"""Harmonic packing: every id once, in whole sequences, as the tokenizers library gives them."""

import functools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import packing

FILE = "/opt/tokenizers/word_bpe_49k.json"
ODD = [
    "", None, " \n\t ", "one", "It's we'll ''s x", "a<|endoftext|>b <|startoftext|> c", "a \x01 b\x01", "é ́x Äb", "İI Σσς ẞ", "a b\u0085c d\x1ce",
    "한글 한", "Å Ω क़", "\x00 \x7f", "🙂🙂 👩‍👩‍👧 x", "1234 12a3b", "!?!? -- #$%", "word " * 9000, "x" * 30_000, "ßŉ ﬁ",
]


@functools.cache
def tokenizer():
    import tokenizers

    return tokenizers.Tokenizer.from_file(FILE)


def library_ids(text, end):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, end]


def texts(n, seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéßλ'1.-") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    return [" ".join(rng.choices(words, k=rng.choice([1, 5, 30, 300, 2000]))) for _ in range(n)]


def test_words_encode_as_the_library_does():
    encoder = packing.WordEncoder.of_worker(FILE)
    rng = random.Random(11)
    alphabet = "aB 'sS\n\t\x01é́ <|>endoftext1#가Σ🙂"
    strings = ODD + ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(2000)] + texts(20)
    for _ in range(3):  # words are remembered from their second time on
        flat, to = encoder.encode(strings, 2)
        for k, text in enumerate(strings):
            assert flat[to[k] : to[k + 1]].tolist() == library_ids(text, 2) if k < 60 or k % 20 == 0 else True


def test_rests_are_cut_into_parts_that_waste_little():
    cuts = packing.rest_cuts(4096)
    assert all(sum(c) == n for n, c in enumerate(cuts))
    assert max(map(len, cuts)) <= 5
    assert max(4096 - 4096 // p * p for c in cuts for p in c) <= 4096 / 64
    assert [4096 // (4096 // p) >= p for c in cuts for p in c]


@pytest.mark.parametrize(("parts", "fan", "capacity"), [(1, 64, 256), (7, 2, 256), (5, 64, 4096), (3, 2, 100)])
def test_sequences_hold_every_id_once(spark, parts, fan, capacity):
    rows = [(i if i % 11 else None, t, i) for i, t in enumerate(ODD + texts(120) + ["again"] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(parts, "ids")
    got = packing.pack_documents(df, FILE, capacity=capacity, fan=fan).collect()
    want = Counter((r[0], tuple(library_ids(r[1], 2))) for r in rows)
    assert len({r["sequence_id"] for r in got}) == len(got)
    by_doc, single = defaultdict(list), Counter()
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert 0 < len(ids) == r["n_tokens"] <= capacity
        assert r["padded"] == (r["n_tokens"] if r["n_tokens"] & (r["n_tokens"] - 1) == 0 else capacity)
        at = 0
        for p in r["pieces"]:
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
            piece = tuple(ids[p["offset"] : at].tolist())
            by_doc[p["doc_id"]].append((p["start"], piece, p["doc_tokens"]))
            single[piece] += 1
        assert at == len(ids)
    # ids of documents whose doc_id is their own, put together again
    mine = Counter(r[0] for r in rows)
    for doc_id, ids in want:
        if mine[doc_id] == 1:
            pieces = sorted(by_doc[doc_id])
            assert [p[0] for p in pieces] == np.cumsum([0, *[len(p[1]) for p in pieces[:-1]]]).tolist()
            assert tuple(i for p in pieces for i in p[1]) == ids and {p[2] for p in pieces} == {len(ids)}
    assert sum(r["n_tokens"] for r in got) == sum(len(ids) * n for (_, ids), n in want.items())
    assert sum(r["padded"] - r["n_tokens"] for r in got) <= sum(r["n_tokens"] for r in got) / (50 if capacity > 200 else 20)


def test_digests_are_read_from_the_ids(spark):
    df = spark.createDataFrame(list(enumerate(ODD + texts(30))), "doc_id long, text string")
    packed = packing.pack_documents(df, FILE)
    got = {(r["doc_id"], r["start"]): r for r in packing.piece_digests(packed).collect()}
    at = Counter()
    for doc_id, text in enumerate(ODD + texts(30)):
        ids = np.array(library_ids(text, 2), "<u4")
        while at[doc_id] < len(ids):
            r = got.pop((doc_id, at[doc_id]))
            assert r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
            at[doc_id] += r["length"]
    assert not got
    repeated = packing.piece_digests(packing.pack_documents(df, FILE))
    assert repeated.exceptAll(packing.piece_digests(packing.pack_documents(df, FILE))).count() == 0


def test_packing_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    packed = packing.pack_documents(empty, FILE)
    assert packed.count() == 0 and packing.piece_digests(packed).count() == 0
    one = packing.pack_documents(spark.createDataFrame([("x", None)], "doc_id string, text string"), FILE).first()
    assert (one["n_tokens"], one["padded"], one["pieces"][0]["doc_id"]) == (1, 1, "x")
    with pytest.raises(ValueError):
        packing.WordEncoder(__import__("tokenizers").Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json"))


def test_full_classes_hold_a_fixed_number_of_pieces(spark):
    df = spark.createDataFrame(list(enumerate(texts(300, 9))), "doc_id long, text string").coalesce(1)
    packed = packing.pack_documents(df, FILE, capacity=512)
    first = packed.where(F.col("sequence_id") < (1 << 56)).collect()
    assert first
    for r in first:  # those that workers filled on their own
        assert {512 // p["length"] for p in r["pieces"]} == {len(r["pieces"])}
