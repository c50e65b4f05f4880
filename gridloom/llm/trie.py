"""A trie of the prefixes that conversations share, with subtree counts.

A turn is known by 128 bits of the SHA-256 of its role and text, so texts are
read once and not moved. Conversations of the same turns are one path with a
count. Paths are dealt to tasks by a hash of their first turn; a task builds
the tries of its first turns as dictionaries of pointers and sums them up from
children to parents, without recursion.

First turns with more turns below than a task takes are dealt again by later
turns: of every prefix the turns below are counted, and a path leaves the open
part of its trie at the first prefix that fits a task. An open node is known by
its depth and the xor of position-bound hashes of its turns, which is a running
aggregate. The open part is summed without gathering it: an open node belongs
to the path that stays open longest of those through it, so a path's own nodes
are its last open ones, one after the other, and there are at most as many such
paths as open leaves. Inside a path sums run from its last node up; a path's
total also goes to each open node above its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import materialize

#: Turns of different paths that a task takes, and copies that a small side of a join is made in, against hot keys.
TURNS, SALTS = 100_000, 32
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NOTHING = hashlib.sha256(b"").hexdigest()


def number_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pos, key, n_bytes: the turns of each conversation from 1 on, by turn (nulls first), then by key.

    A null role or text counts as empty; repeated rows are turns each. Rows of
    a null conv_id belong to no conversation and are left out. Other columns
    are ignored.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    keyed = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.substring(F.unhex(F.sha2(told.cast("binary"), 256)), 1, 16).alias("key"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    return keyed.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "key", "n_bytes")


def share_beginnings(turns: DataFrame, family: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, pos, key, n_bytes) of rebuilt conversations, and all their conv_ids; from number_turns().

    Conversation c begins with the first h turns of c - c % family, as many as
    that one has, and goes on with its own turns behind its first h; h is the
    crc32 of the decimal c modulo most + 1. A conversation may be left without
    turns.
    """
    turns = materialize(turns, "trie-turns")
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    convs = turns.where("pos = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("from"), taken.alias("h"))
    heads = turns.where((F.col("pos") <= most) & (F.col("conv_id") % family == 0))
    heads = heads.groupBy(F.col("conv_id").alias("from")).agg(F.array_sort(F.collect_list(F.struct("pos", "key", "n_bytes"))).alias("head"))
    plan = convs.join(heads, "from", "left").select("conv_id", "h", F.slice("head", F.lit(1), F.col("h").cast("int")).alias("head"))
    begin = plan.select("conv_id", F.inline("head"))
    size = plan.select("conv_id", F.coalesce(F.size("head"), F.lit(0)).alias("had"))  # size(null) is null in ANSI mode, -1 outside of it
    size = size.withColumn("had", F.greatest("had", F.lit(0)))
    own = turns.where(F.col("pos") > taken).join(size, "conv_id").select("conv_id", (F.col("pos") - taken + F.col("had")).alias("pos"), "key", "n_bytes")
    return materialize(begin.union(own), "trie-paths"), convs.select("conv_id")


def _marks(pos: Column, key: Column) -> tuple[Column, Column]:
    return F.xxhash64(pos, key), F.xxhash64(key, pos)


def _ends(batches):
    """Of rows sorted by length, x1, x2 and conv_id: a row per different sequence, with the digest of its conv_ids.

    The digest takes in ids as they come, so no group of equal conversations is held.
    """
    now = None

    def row():
        return [now["conv"], now["key"][0], now["first"], now["n"], now["sha"].hexdigest()]

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id").to_numpy()
        keys = np.stack([batch.column(c).to_numpy() for c in ("length", "x1", "x2")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        out = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
            key = tuple(keys[:, a].tolist())
            told = ",".join(map(str, ids[a:b].tolist())).encode()
            if now and now["key"] == key:
                now["sha"].update(b"," + told)
                now["n"] += b - a
            else:
                if now:
                    out.append(row())
                now = {"key": key, "conv": int(ids[a]), "first": batch.column("first")[a].as_py(), "n": b - a, "sha": hashlib.sha256(told)}
        yield _rows(out)
    if now:
        yield _rows([row()])


def _rows(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["conv_id", "length", "first", "n", "sha"])


def _sequences(paths: DataFrame, members: DataFrame) -> DataFrame:
    """conv_id (the smallest), length, first (its first turn), n, sha: a row per different sequence of turns, the empty one too."""
    x1, x2 = _marks(F.col("pos"), F.col("key"))
    rows = paths.select("conv_id", "pos", "key", x1.alias("x1"), x2.alias("x2")).unionByName(
        members.select("conv_id", *[F.lit(None).cast(k).alias(c) for c, k in (("pos", "long"), ("key", "binary"), ("x1", "long"), ("x2", "long"))])
    )
    whole = rows.groupBy("conv_id").agg(
        F.count("pos").alias("length"), F.coalesce(F.bit_xor("x1"), F.lit(0)).alias("x1"), F.coalesce(F.bit_xor("x2"), F.lit(0)).alias("x2"), F.min_by("key", "pos").alias("first")
    )
    dealt = whole.repartition("length", "x1", "x2").sortWithinPartitions("length", "x1", "x2", "conv_id")
    return materialize(dealt.mapInArrow(_ends, "conv_id long, length long, first binary, n long, sha string"), "trie-ends")


def grow(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes of the tries of some paths, from rows (conv_id, pos, key, n_bytes, n, sha, g1, g2, parent).

    g1 and g2 say which subtree a path belongs to; its first row here is the
    subtree's top, parent the conv_id of the node above. n conversations end at
    a row with a sha. A path is put in after those of smaller conv_ids, so the
    one that makes a node is its smallest member, and a node comes after its
    parent: going back from the last one, children are summed up first.
    """
    rows = rows.sort_values(["conv_id", "pos"], kind="stable")
    tops: dict[tuple[int, int], int] = {}
    below: list[dict[bytes, int]] = []
    conv, depth, up, above, size, own, sha = [], [], [], [], [], [], []
    path = at = None
    for c, p, key, n_bytes, n, s, g1, g2, parent in zip(*[rows[k].tolist() for k in ("conv_id", "pos", "key", "n_bytes", "n", "sha", "g1", "g2", "parent")], strict=True):
        if c != path:
            path, at = c, -1
        next_ones, mark = (tops, (g1, g2)) if at < 0 else (below[at], bytes(key))
        node = next_ones.get(mark)
        if node is None:
            node = next_ones[mark] = len(conv)
            below.append({})
            for column, value in ((conv, c), (depth, p), (up, at), (above, parent if at < 0 else conv[at]), (size, n_bytes), (own, 0), (sha, NOTHING)):
                column.append(value)
        at = node
        if isinstance(s, str):
            own[at], sha[at] = n, s
    members, leaves, saved = own, [0] * len(conv), [0] * len(conv)
    for node in range(len(conv) - 1, -1, -1):
        leaves[node] += not below[node]
        saved[node] += (members[node] - 1) * size[node]
        if up[node] >= 0:
            members[up[node]] += members[node]
            leaves[up[node]] += leaves[node]
            saved[up[node]] += saved[node]
    return pd.DataFrame(
        {
            "conv_id": conv, "depth": depth, "parent_conv_id": above, "n_convs": members, "n_children": [len(b) for b in below],
            "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": sha, "is_top": [u < 0 for u in up],
        }
    )


def _grown(rows: DataFrame, tasks: int) -> DataFrame:
    bucket = F.pmod(F.xxhash64("g1", "g2"), F.lit(tasks))
    rows = rows.select("conv_id", "pos", "key", "n_bytes", "n", "sha", "g1", "g2", "parent", bucket.alias("bucket"))
    return materialize(rows.groupBy("bucket").applyInPandas(grow, f"{NODE}, is_top boolean"), "trie-nodes")


def _salted(many: DataFrame, few: DataFrame, on: list[str], how: str) -> DataFrame:
    """many join few: a key that many rows of many have is spread over SALTS copies of few's row."""
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("_salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")).join(copies, [*on, "_salt"], how).drop("_salt")


def _split(rows: DataFrame, limit: int, tasks: int) -> DataFrame:
    """Nodes (and is_top = false) of tries whose first turns have more than limit turns below. rows: conv_id, pos, key, n_bytes, length, n, sha."""
    path = W.partitionBy("conv_id").orderBy("pos")
    upto = path.rowsBetween(W.unboundedPreceding, W.currentRow)
    marks = _marks(F.col("pos"), F.col("key"))
    rows = materialize(rows.withColumns({c: F.bit_xor(m).over(upto) for c, m in zip(("x1", "x2"), marks, strict=True)}), "trie-deep")
    sizes = rows.groupBy("pos", "x1", "x2").agg(
        F.sum(F.col("length") - F.col("pos") + 1).alias("below"), F.min("conv_id").alias("node"), F.sum("n").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.max("sha").alias("sha")
    )
    large = materialize(sizes.where(F.col("below") > limit), "trie-large")
    on_large = _salted(rows.select("conv_id", "pos", "x1", "x2"), large.select("pos", "x1", "x2", "node"), ["pos", "x1", "x2"], "inner")
    on_large = materialize(on_large.select("conv_id", "pos", "node"), "trie-open")
    exits = on_large.groupBy("conv_id").agg(F.max("pos").alias("open_to"), F.max_by("node", "pos").alias("parent"))

    rest = rows.join(exits, "conv_id").where(F.col("pos") > F.col("open_to"))
    rest = rest.withColumns({"g1": F.first("x1").over(path), "g2": F.first("x2").over(path)})
    small = _grown(rest, tasks)

    # each open node to the path through it that stays open longest
    known = on_large.join(exits.select("conv_id", "open_to"), "conv_id")
    owners = known.groupBy("node", "pos").agg(F.max(F.struct("open_to", (-F.col("conv_id")).alias("conv"))).alias("best"))
    owners = owners.select("node", "pos", (-F.col("best.conv")).alias("conv_id"), F.lit(True).alias("own"))
    whole = W.partitionBy("conv_id")
    held = known.join(owners, ["node", "pos", "conv_id"], "left").withColumns({"owns": F.max("own").over(whole), "up": F.lag("node").over(path)})
    held = held.where("owns").select("conv_id", "node", "pos", "up", F.coalesce("own", F.lit(False)).alias("own"))
    hung = small.where("is_top").groupBy(F.col("parent_conv_id").alias("node"), (F.col("depth") - 1).alias("pos")).agg(
        F.count("*").alias("n_tops"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )
    facts = large.select("node", "pos", "n_convs", "n_bytes", "sha").join(hung, ["node", "pos"], "left").na.fill(0, ["n_tops", "leaves", "saved"])
    facts = facts.withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("n_bytes"))
    held = held.join(facts, ["node", "pos"]).withColumns({c: F.when(F.col("own"), F.col(c)).otherwise(0) for c in ("leaves", "saved")})
    upward = whole.orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, W.currentRow)
    # above its own nodes, where a path adds nothing, the sum from its last node up is its total
    held = materialize(held.withColumns({c: F.sum(c).over(upward) for c in ("leaves", "saved")}), "trie-held")
    sums = held.groupBy("node", "pos").agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.max(F.when(F.col("own"), F.col("up"))).alias("parent_conv_id"),
        *[F.max(c).alias(c) for c in ("n_convs", "n_tops", "sha")],
    )
    open_below = held.where("own and pos > 1").groupBy(F.col("up").alias("node"), (F.col("pos") - 1).alias("pos")).agg(F.count("*").alias("n_open"))
    nodes = sums.join(open_below, ["node", "pos"], "left").select(
        F.col("node").alias("conv_id"), F.col("pos").alias("depth"), "parent_conv_id", "n_convs", (F.col("n_tops") + F.coalesce("n_open", F.lit(0))).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(NOTHING)).alias("ends_sha256"), F.lit(False).alias("is_top"),
    )
    return small.union(nodes)


def prefix_trie(paths: DataFrame, members: DataFrame, limit: int = TURNS) -> DataFrame:
    """A row per node, the root included: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    paths(conv_id, pos from 1 on, key, n_bytes) are the turns of conversations,
    each place once; members(conv_id), each once, are all of them, those without turns too. A
    node is a different sequence of first turns. conv_id is its smallest
    member, with depth it tells nodes apart. saved_tokens sums, over a node's
    subtree, the bytes of each node's last turn for all members but one.
    ends_sha256 is the SHA-256 of the conv_ids that end at the node, ascending
    in decimal, with commas. Without members there are no rows; with turnless
    members only, the root is a leaf.
    """
    sequences = _sequences(paths, members)
    firsts = sequences.where("length > 0").groupBy("first").agg(F.sum("length").alias("below"))
    firsts = materialize(firsts, "trie-firsts")
    turns, most = firsts.agg(F.sum("below"), F.max("below")).first()
    least, n_convs = sequences.agg(F.min("conv_id"), F.sum("n")).first()
    if least is None:
        return members.sparkSession.createDataFrame([], NODE)
    tasks = 1 + 4 * (turns or 0) // limit
    told = sequences.where("length > 0")
    if (most or 0) > limit:
        told = _salted(told, firsts.where(F.col("below") > limit).withColumn("split", F.lit(True)).drop("below"), ["first"], "left")
    else:
        told = told.withColumn("split", F.lit(None).cast("boolean"))
    rows = paths.join(told, "conv_id").withColumn("sha", F.when(F.col("pos") == F.col("length"), F.col("sha")))
    g1, g2 = _marks(F.lit(1).cast("long"), F.col("first"))
    whole = rows.where("split is null").withColumns({"g1": g1, "g2": g2, "parent": F.lit(least)})
    nodes = _grown(whole, tasks)
    if (most or 0) > limit:
        split = _split(rows.where("split").drop("split", "first"), limit, tasks)
        nodes = materialize(nodes.union(split.withColumn("parent_conv_id", F.coalesce("parent_conv_id", F.lit(least)))), "trie-all")
    nodes = nodes.drop("is_top")
    ended = sequences.where("length = 0").select("sha").first()
    root = nodes.where("depth = 1").agg(F.count("*").alias("n"), F.sum("n_leaves").alias("leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved"))
    root = root.select(
        F.lit(least).alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(n_convs).alias("n_convs"), F.col("n").alias("n_children"),
        F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.lit(ended["sha"] if ended else NOTHING).alias("ends_sha256"),
    )
    return nodes.union(root)


#: crc32 and all prefixes in SQL; a prefix is known by the list of its turns' hashes.
ORACLE = r"""
WITH t AS (
  SELECT conv_id, list({'k': sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 'b': strlen(coalesce(text, ''))}
                       ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT conv_id, own, conv_id - conv_id % 5 AS source,
         (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
              lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 9)::INT AS h
  FROM t),
r AS (SELECT h.conv_id, list_concat(coalesce(s.own[1:h.h], []), h.own[h.h + 1:]) AS turns FROM h LEFT JOIN t s ON s.conv_id = h.source),
p AS (
  SELECT conv_id, d, sha256(list_aggregate(list_transform(turns[1:d], lambda x: x.k), 'string_agg', ',')) AS k,
         CASE WHEN d > 1 THEN sha256(list_aggregate(list_transform(turns[1:d - 1], lambda x: x.k), 'string_agg', ',')) ELSE 'root' END AS up,
         turns[d].b AS b, len(turns) = d AS is_end
  FROM (SELECT *, unnest(range(1, len(turns) + 1)) AS d FROM r)
  UNION ALL SELECT conv_id, 0, 'root', NULL, 0, len(turns) = 0 FROM r),
n AS (
  SELECT k, any_value(up) AS up, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
  FROM p GROUP BY k, d),
c AS (SELECT n.*, (SELECT count(*) FROM n m WHERE m.up = n.k) AS n_children, u.conv_id AS parent_conv_id FROM n LEFT JOIN n u ON u.k = n.up),
m AS (SELECT c.conv_id, c.d, q.k AS above, c.n_children = 0 AS leaf, (c.n_convs - 1) * c.b AS saved FROM c JOIN p q ON q.conv_id = c.conv_id AND q.d <= c.d),
s AS (SELECT above, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens FROM m GROUP BY above)
SELECT c.conv_id, c.d::BIGINT AS depth, c.parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM c JOIN s ON s.above = c.k
"""
