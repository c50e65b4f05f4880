"""The conversation trie against plain dictionaries of prefixes."""

import hashlib
import random
import zlib

import pytest

from gridloom.llm import trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def own_turns(rows):
    """conv_id -> [(role, text)], in the order of the operator."""
    found = {}
    for c, turn, role, text in rows:
        if c is not None:
            told = f"{len(role or '')}:{role or ''}{text or ''}"
            found.setdefault(c, []).append(((turn is not None, turn or 0, hashlib.sha256(told.encode()).digest()), (role or "", text or "")))
    return {c: [t for _, t in sorted(ts, key=lambda x: x[0])] for c, ts in found.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        source = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(source, [])[:h] + turns[h:]
    return out


def plain_nodes(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    below = {k: [] for k in members}
    for k in members:
        if k:
            below[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[b] for b in below[k]) or 1
        saved[k] = sum(saved[b] for b in below[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(below[k]), leaves[k], saved[k],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k)).encode()).hexdigest())
        for k, m in members.items()
    )


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def run(spark, rows, limit=trie.TURNS):
    turns = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, pos string, n long")
    return found(trie.prefix_trie(*trie.share_beginnings(trie.number_turns(turns)), limit=limit))


def conversations(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for c in range(-7, n):
        if c % 13 == 4:
            continue
        for t in range(rng.choice([1, 2, 3, 9, 12])):
            rows.append((c, t if rng.random() > 0.1 else None if t == 0 else t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "ä", "", None, "long " * 50])))
    return rows + [(None, 0, "user", "nobody"), (10**12, 0, "user", "alone"), (10**12, 0, "user", "alone")]


def direct(spark, convs, limit):
    rows = [(c, p + 1, hashlib.sha256(repr(t).encode()).digest()[:16], len(t[1].encode())) for c, ts in convs.items() for p, t in enumerate(ts)]
    paths = spark.createDataFrame(rows, "conv_id long, pos long, key binary, n_bytes long")
    return found(trie.prefix_trie(paths, spark.createDataFrame([(c,) for c in convs], "conv_id long"), limit=limit))


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("limit", [4, 30, trie.TURNS])
def test_nodes_match_plain_dictionaries(spark, seed, limit):
    rows = conversations(seed)
    assert run(spark, rows, limit) == plain_nodes(rebuilt(own_turns(rows)))


@pytest.mark.parametrize("limit", [1, 5])
def test_hot_first_turns_long_chains_and_copies(spark, limit):
    turn = lambda *names: [("user", n) for n in names]
    rng = random.Random(3)
    convs = {c: turn("hot", *(rng.choice("ab") for _ in range(rng.randint(0, 7)))) for c in range(60)}
    convs |= {100 + k: turn("hot", *["chain"] * (25 - k)) for k in range(12)}  # one leaves at every depth
    convs |= {200 + k: turn("hot", *["chain"] * (k + 2), "off", str(k), "x" * k) for k in range(12)}
    convs |= {300 + k: turn("same", "same", "same") for k in range(40)}
    convs |= {400 + k: [] for k in range(3)}
    convs |= {500 + k: turn("hot", str(k)) for k in range(30)}  # many children of one turn
    convs |= {600: turn(*["deep"] * 60)}
    assert direct(spark, convs, limit) == plain_nodes(convs)


def test_turnless_conversations_and_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "x")]) == []
    assert direct(spark, {7: [], 3: []}, 10) == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,7").hexdigest())]
    rows = [(1, 0, "user", "gone")]  # conversation 0 isn't there, and 1 % 9 of its turns are dropped or kept by its crc32
    assert run(spark, rows) == plain_nodes(rebuilt(own_turns(rows)))
    long = [(5, 0, "user", "ab " * 700_000), (5, 1, "user", "b"), (6, 0, "user", "c")]
    assert run(spark, long) == plain_nodes(rebuilt(own_turns(long)))


def test_ids_of_equal_conversations_are_digested_in_order_over_batches(spark):
    convs = {c: [("user", "x")] for c in range(25_000)}
    got = direct(spark, convs, 100)
    assert got == plain_nodes(convs)
