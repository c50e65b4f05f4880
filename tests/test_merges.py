"""Merges learned in rounds against the learner that takes one pair at a time."""

import random

import pytest

from gridloom.operators import merges, vocab


def counts_of(seed, n=150):
    rng = random.Random(seed)
    words = ["".join(rng.choices("aab cdeé", k=rng.randint(1, 8))) for _ in range(n)]
    return {w: rng.choice([1, 1, 2, 3, 50]) for w in words}


@pytest.mark.parametrize(("seed", "top"), [(1, 1024), (2, 1024), (3, 6)])
def test_rounds_learn_what_single_merges_do(spark, seed, top):
    counts = counts_of(seed)
    want = vocab.BytePairs.from_pretokens(counts, 40).merges
    df = spark.createDataFrame(list(counts.items()), "pretoken string, n int").repartition(3)
    assert merges.learn_merges(df, 40, top) == want


def test_batches_hold_only_pairs_that_keep_their_order():
    top = [(1, 2, 9), (3, 4, 8), (2, 5, 7), (6, 7, 6), (8, 9, 6)]
    assert merges.next_batch(top, True, 10) == [(1, 2), (3, 4)]
    assert merges.next_batch([(1, 2, 9), (3, 4, 7), (2, 5, 7)], True, 10) == [(1, 2)]
    assert merges.next_batch([(1, 2, 9), (3, 4, 8), (5, 6, 8)], False, 10) == [(1, 2)]
    assert merges.next_batch([(1, 2, 9), (3, 4, 8), (5, 6, 7)], True, 2) == [(1, 2), (3, 4)]
    assert merges.next_batch([(1, 1, 9)], True, 5) == [(1, 1)] and merges.next_batch([], True, 5) == []


def test_it_ends_when_no_pair_is_left(spark):
    df = spark.createDataFrame([("aaa", 2), ("", 5), (None, 3), ("b", 1)], "pretoken string, n long")
    assert merges.learn_merges(df, 10) == vocab.BytePairs.from_pretokens({"aaa": 2, "": 5, "b": 1}, 10).merges == [(97, 97), (256, 97)]
    assert merges.learn_merges(df.limit(0), 10) == []
