"""MinHash near-duplicates with sequential Bayesian verification.

1. Shingle sets are hashed to signatures. Documents with equal sets share a
   key and one of them, the one with the smallest id, stands for all.
2. Bands of the signatures put representatives in buckets. Each member is
   compared to its bucket's hub (the smallest id), and where that leaves
   several components, to the member with the most links so far.
3. Candidates are compared batch by batch of their signatures. With m of n
   agreeing, a pair is dropped once the posterior chance that its similarity
   reaches the threshold is below miss. Survivors are verified on full sets.
4. What stays open is compared in cells: members outside of their bucket's
   largest component against all others of it. Those that pass the same test
   bring their sets to a cell, which verifies all pairs at once by products of
   0-1 matrices and hands on a spanning forest of the links, so no task emits
   more links than it has members. A bucket of at most SIDE members is one
   cell. Buckets with more than SIDE members outside of their main component
   are filed again by longer bands, which split what is not similar enough; only
   what that leaves crowded is dealt to several cells.
5. Components of the verified links, spread to all copies.

At similarity 0.8, 32 bands of 5 rows miss a pair with chance 3e-6.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import discard, materialize
from .textcore import Words, binary_column, blocks, free_name, give_back, matrix, mix, shingle_sets, utf8

BANDS, ROWS, BATCH = 32, 5, 32
#: Members of a side of a cell that compares signatures, and shingles of one that compares sets.
SIDE, SET_SIDE = 1024, 1 << 19
#: Bands and rows of the second filing: a pair at 0.8 is missed with chance 1e-5, one at 0.7 shares a band with chance 0.014 instead of 0.17.
LONG = (162, 12)
FILTER_BITS = 1 << 25


def hash_family(k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and summands of k hash functions."""
    seeds = mix(np.arange(1, 2 * k + 1, dtype=np.uint64) + np.uint64(salt))
    return (seeds[:k] | np.uint64(1)).astype(np.uint32)[:, None], seeds[k:].astype(np.uint32)[:, None]


def least_hashes(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Smallest value of each hash function over a set."""
    a, b = family
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    sig = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(sig, (a * x[at : at + 2048] + b).min(axis=1), out=sig)
    return sig


def signatures(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_key, sig, bands of every row; the last three null for empty sets."""
    k = bands * rows

    def run(batches):
        family = hash_family(k)
        for batch in blocks(batches):
            ids, sizes, keys, sigs, filed = batch.column("doc_id"), [], [], [], []
            for s in shingle_sets(Words(*utf8(batch.column("text")), lower=True), words):
                sizes.append(len(s))
                if not len(s):
                    keys.append(None), sigs.append(None), filed.append(None)
                    continue
                sig = least_hashes(s, family)
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sigs.append(sig.tobytes())
                filed.append(band_keys(sig[None], bands, rows)[0])
            lengths = np.array([0 if v is None else bands for v in filed])
            flat = np.concatenate([np.zeros(0, np.int64), *[v for v in filed if v is not None]])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), binary_column(keys), binary_column(sigs), lists],
                ["doc_id", "n_shingles", "set_key", "sig", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary, bands array<long>")


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Bucket of each band of each signature."""
    joint = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64) + np.uint64(1 << 40)), (len(sig), bands))
    for column in np.moveaxis(sig.reshape(len(sig), bands, rows), 2, 0):
        joint = mix(joint ^ column.astype(np.uint64))
    return joint.view(np.int64)


def least_agreeing(k: int, threshold: float, miss: float, batch: int = BATCH) -> list[tuple[int, int]]:
    """(n, fewest agreeing hashes with which a pair goes on) after each batch, under a uniform prior of similarity."""
    s = (np.arange(20000) + 0.5) / 20000
    high = s >= threshold
    out = []
    for n in range(batch, k + 1, batch):
        for m in range(n + 1):
            density = m * np.log(s) + (n - m) * np.log1p(-s)
            density = np.exp(density - density.max())
            if density[high].sum() / density.sum() >= miss:
                break
        out.append((n, m))
    return out


def bayes_mask(x: np.ndarray, y: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of x and y (signatures) go through all batches."""
    alive = np.arange(len(x))
    agree = np.zeros(len(x), np.int32)
    at = 0
    for n, least in bounds:
        agree[alive] += (x[alive, at:n] == y[alive, at:n]).sum(axis=1, dtype=np.int32)
        alive = alive[agree[alive] >= least]
        at = n
    mask = np.zeros(len(x), bool)
    mask[alive] = True
    return mask


def prune(pairs: DataFrame, heads: DataFrame, k: int, bounds, percent: int) -> DataFrame:
    """The pairs (a, b) whose set sizes allow a link and whose signatures pass the sequential test."""
    sides = [heads.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sig").alias(f"s{c}")) for c in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (matrix(batch.column(c), np.uint32, k) for c in ("sa", "sb"))
                yield batch.select(["a", "b"]).filter(pa.array(bayes_mask(x, y, bounds)))

    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def shingled(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """doc_id, shingles of the wanted documents (and a few others), without a shuffle of texts.

    The wanted ids go to the scan as a bitmap of hashes, whose size is fixed.
    """
    bit = F.pmod(F.xxhash64("doc_id"), FILTER_BITS) + 1  # bitmap buckets start at 1
    rows = (
        wanted.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    )
    bitmap = np.zeros(FILTER_BITS, bool)
    for row in rows:
        span = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little").astype(bool)
        start = (row["k"] - 1) * len(span)
        bitmap[start : start + len(span)] |= span[: FILTER_BITS - start]
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    def sets(batches):
        held = np.unpackbits(shared.value, count=FILTER_BITS).astype(bool)
        for batch in batches:
            some = batch.filter(pa.array(held[(batch.column("bit").to_numpy() - 1) % FILTER_BITS]))
            for part in blocks(iter([some])):
                found = shingle_sets(Words(*utf8(part.column("text")), lower=True), words)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), binary_column([s.tobytes() for s in found])], ["doc_id", "shingles"])

    texts = docs.where("doc_id is not null").select("doc_id", "text", bit.alias("bit"))
    return materialize(texts.mapInArrow(sets, "doc_id long, shingles binary"), "shingles")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= percent * (len(x) + len(y) - inter)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union of their full shingle sets(doc_id, shingles)."""

    def run(batches):
        for batch in batches:
            x, y = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)] for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array([similar(*s, percent) for s in zip(x, y, strict=True)], pa.bool_()))

    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (bucket, doc_id, weight) of buckets with more than one component, with component, n, minors and minor.

    Minor members are outside of their bucket's heaviest component; n is the weight of all, minors that of the minor ones.
    """
    named = members.join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    named = named.select("bucket", "doc_id", "weight", F.coalesce("component", "doc_id").alias("component"))
    parts = named.groupBy("bucket", "component").agg(F.sum("weight").alias("c"))
    mixed = (
        parts.groupBy("bucket")
        .agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("kinds"))
        .where("kinds > 1")
    )
    return named.join(mixed, "bucket").select(
        "bucket", "doc_id", "weight", "component", "n", (F.col("n") - F.col("most")).alias("minors"), (F.col("component") != F.col("main")).alias("minor")
    )


def cells(open_: DataFrame, side: int) -> DataFrame:
    """Members of unsettled() dealt to cells (bucket, i, j), with left and right flags.

    A bucket that weighs at most side is one cell, where each member stands
    once. Of a heavier one a cell has members of about the weight side of two
    kinds: left ones, which are minor, and right ones, which are any. A minor
    member meets each member of its bucket in one cell.
    """
    sides = open_.select(
        "bucket", "doc_id", "component", "minor",
        F.when(F.col("n") <= side, 1).otherwise(F.ceil(F.col("minors") / side)).cast("int").alias("nl"),
        F.ceil(F.col("n") / side).cast("int").alias("na"),
        F.xxhash64("doc_id").alias("h"),
    )
    only = sides.where("na = 1").select("bucket", F.lit(0).alias("i"), F.lit(0).alias("j"), "doc_id", "component", F.col("minor").alias("left"), F.lit(True).alias("right"))
    many = sides.where("na > 1")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    right = many.select("bucket", upto("nl").alias("i"), F.pmod("h", "na").cast("int").alias("j"), "doc_id", "component", F.lit(False).alias("left"), F.lit(True).alias("right"))
    left = many.where("minor").select("bucket", F.pmod("h", "nl").cast("int").alias("i"), upto("na").alias("j"), "doc_id", "component", F.lit(True).alias("left"), F.lit(False).alias("right"))
    return only.union(right).union(left)


def _by_cell(batch: pa.RecordBatch):
    """Fields of each row's members, and places of the left and right ones."""
    lists = batch.column("m")
    flat = lists.flatten()
    edges = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    ids, parts, left, right = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "component", "left", "right"))
    for n, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        yield batch.column("bucket")[n].as_py(), flat.slice(lo, hi - lo), ids[lo:hi], parts[lo:hi], np.flatnonzero(left[lo:hi]), np.flatnonzero(right[lo:hi])


def close_members(dealt: DataFrame, heads: DataFrame, k: int, bounds) -> DataFrame:
    """Members (bucket, doc_id, weight: their shingles) that pass the sequential test with one of another component in a cell of their bucket."""

    def run(batches):
        for batch in batches:
            for bucket, flat, ids, parts, left, right in _by_cell(batch):
                sig, found = matrix(flat.field("sig"), np.uint32, k), np.zeros(len(ids), bool)
                for r in left:
                    other = right[parts[right] != parts[r]]
                    passed = other[bayes_mask(np.broadcast_to(sig[r], (len(other), k)), sig[other], bounds)]
                    found[passed] = True
                    found[r] |= len(passed) > 0
                n, weight = int(found.sum()), flat.field("n_shingles").filter(pa.array(found))
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * n, pa.int64()), pa.array(ids[found]), weight], ["bucket", "doc_id", "weight"])
        give_back()

    members = F.collect_list(F.struct("doc_id", "component", "left", "right", "n_shingles", "sig"))
    grouped = dealt.join(heads.select("doc_id", "n_shingles", "sig"), "doc_id").groupBy("bucket", "i", "j").agg(members.alias("m"))
    return grouped.select("bucket", "m").mapInArrow(run, "bucket long, doc_id long, weight long").distinct()


def shared_sizes(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each left with each right set: products of blocks of the 0-1 matrices of their common elements."""
    flat = [np.concatenate([np.zeros(0, np.uint64), *s]) for s in (left, right)]
    rows = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right)]
    common = np.intersect1d(*flat)
    found = []
    for values, row in zip(flat, rows, strict=True):
        at = np.minimum(np.searchsorted(common, values), max(len(common) - 1, 0))
        keep = common[at] == values if len(common) else np.zeros(len(values), bool)
        order = np.argsort(at[keep], kind="stable")
        found.append((at[keep][order], row[keep][order]))
    out = np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, len(common), width):
        blocks_ = []
        for (at, row), size in zip(found, out.shape, strict=True):
            lo, hi = np.searchsorted(at, [begin, begin + width])
            block = np.zeros((size, width), np.float32)
            block[row[lo:hi], at[lo:hi] - begin] = 1
            blocks_.append(block)
        out += blocks_[0] @ blocks_[1].T
    return out.astype(np.int64)


def joining_links(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components: a spanning forest of all links of full sets in each cell."""

    def run(batches):
        for batch in batches:
            for _, flat, ids, parts, left, right in _by_cell(batch):
                shingles = [np.frombuffer(v.as_buffer(), np.uint64) for v in flat.field("shingles")]
                both = shared_sizes([shingles[x] for x in left], [shingles[x] for x in right])
                size = np.array([len(x) for x in shingles])
                linked = 100 * both >= percent * (size[left][:, None] + size[right][None] - both)
                r, c = np.nonzero(linked & (parts[left][:, None] != parts[right][None]))
                parts, out = parts.copy(), []
                for x, y in zip(left[r].tolist(), right[c].tolist(), strict=True):
                    if parts[x] != parts[y]:
                        out.append(sorted((int(ids[x]), int(ids[y]))))
                        parts[parts == parts[y]] = parts[x]
                yield pa.RecordBatch.from_arrays([pa.array([p[n] for p in out], pa.int64()) for n in (0, 1)], ["a", "b"])
        give_back()

    members = F.collect_list(F.struct("doc_id", "component", "left", "right", "shingles"))
    grouped = dealt.join(sets, "doc_id").groupBy("bucket", "i", "j").agg(members.alias("m"))
    return grouped.select("bucket", "m").mapInArrow(run, "a long, b long").distinct()


def long_bands(sets: DataFrame, bands: int, rows: int) -> DataFrame:
    """bucket, doc_id: documents of sets(doc_id, shingles) filed under bands of more hashes, which fewer pairs share by chance."""
    k = bands * rows

    def run(batches):
        family = hash_family(k, 1 << 50)
        for batch in batches:
            for doc_id, held in zip(batch.column("doc_id"), batch.column("shingles"), strict=True):
                keys = band_keys(least_hashes(np.frombuffer(held.as_buffer(), np.uint64), family)[None], bands, rows)[0]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([doc_id.as_py()] * bands, pa.int64())], ["bucket", "doc_id"])
        give_back()

    return sets.where(F.length("shingles") > 0).mapInArrow(run, "bucket long, doc_id long")


class Linker:
    """Links of the representatives heads(doc_id, n_shingles, sig), found bucket by bucket; labels are the components so far."""

    def __init__(self, docs: DataFrame, heads: DataFrame, links: DataFrame, words: int, percent: int, k: int, miss: float):
        self.docs, self.heads, self.words, self.percent, self.k = docs, heads, words, percent, k
        self.bounds = least_agreeing(k, percent / 100, miss)
        self.links, self.labels = links, None

    def add(self, links: DataFrame) -> None:
        """Takes in links(a, b)."""
        links = materialize(links, "links")
        if self.labels is None or links.limit(1).count():
            self.links = self.links.union(links)
            self.labels = materialize(connected_components(self.links), "labels")

    def to_hubs(self, pairs: DataFrame) -> None:
        survivors = materialize(prune(pairs, self.heads, self.k, self.bounds, self.percent), "survivors")
        sets = shingled(self.docs, survivors.select(F.explode(F.array("a", "b")).alias("doc_id")), self.words)
        self.add(verify(survivors, sets, self.percent))
        self.drop(survivors, sets)

    @staticmethod
    def drop(*spent: DataFrame) -> None:
        """Deletes tables whose results are written."""
        for df in spent:
            discard(df)

    def least_hubs(self, filed: DataFrame) -> DataFrame:
        """Compares members of filed(bucket, doc_id) to the least of their bucket; returns the members of buckets of several."""
        buckets = filed.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1")
        members = materialize(filed.join(buckets, "bucket").select("bucket", "doc_id", "hub", "n"), "members")
        self.to_hubs(members.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct())
        return members.where("n > 2").select("bucket", "doc_id", F.lit(1).alias("weight"))

    def linked_hubs(self, members: DataFrame) -> None:
        """Compares members of unsettled buckets to the one with the most links so far: the original of a group of near copies, mostly."""
        ends = self.links.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("degree"))
        open_ = materialize(unsettled(members, self.labels).join(ends, "doc_id").select("bucket", "doc_id", "component", "degree"), "ranked")
        hubs = open_.groupBy("bucket").agg(F.max(F.struct("degree", "doc_id", "component")).alias("h"))
        hubs = hubs.select("bucket", F.col("h.doc_id").alias("hub"), F.col("h.component").alias("own"))
        met = unsettled(members, self.labels).join(hubs, "bucket").where("component <> own")
        self.to_hubs(met.select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).distinct())
        self.drop(open_)

    def settle(self, members: DataFrame, side: int, long: tuple[int, int] | None) -> None:
        """Compares in cells what the hubs have left open; crowded buckets are filed again by longer bands first."""
        open_ = materialize(unsettled(members, self.labels), "open")
        if long and open_.where(F.col("minors") > side).limit(1).count():
            crowded = open_.where(F.col("minors") > side).select("doc_id").distinct()
            again = materialize(long_bands(shingled(self.docs, crowded, self.words).join(self.heads.select("doc_id"), "doc_id", "left_semi"), *long), "members")
            open_ = open_.where(F.col("minors") <= side)
            self.settle(self.least_hubs(again), side, None)
        close = materialize(close_members(cells(open_, side), self.heads, self.k, self.bounds), "close")
        if close.limit(1).count():
            sets = shingled(self.docs, close.select("doc_id"), self.words)
            self.add(joining_links(cells(unsettled(close, self.labels), SET_SIDE), sets, self.percent))
            self.drop(sets)
        self.drop(close)


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, miss: float = 1e-6, side: int = SIDE, long: tuple[int, int] = LONG
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text).

    Null and empty texts, and texts of separators only, have no shingles and
    link with nothing. A row with a null doc_id links with nothing, has a null
    component and is kept. Rows that repeat a doc_id count as one node with the
    links of all of them. Other columns are ignored. An empty table gives no rows.
    """
    k = bands * rows
    signed = materialize(signatures(docs, words, bands, rows), "signatures")
    full = signed.where("set_key is not null and doc_id is not null")
    twins = materialize(full.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "twins")
    heads = full.join(twins.select("set_key", F.col("rep").alias("doc_id")), ["set_key", "doc_id"], "left_semi")
    heads = materialize(heads.select("doc_id", "n_shingles", "sig", "bands"), "heads")
    twice = full.groupBy("doc_id").agg(F.count_distinct("set_key").alias("k"))
    again = full.join(twice.where("k > 1").select("doc_id"), "doc_id", "left_semi").join(twins, "set_key")
    again = materialize(again.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "links")
    linker = Linker(docs, heads, again, words, percent, k, miss)
    members = linker.least_hubs(heads.select(F.explode("bands").alias("bucket"), "doc_id"))
    linker.linked_hubs(members)
    linker.settle(members, side, long)
    labels = linker.labels
    linker.drop(heads, members)
    spread = twins.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_key", F.coalesce("component", "rep").alias("component")
    )
    named = signed.select("doc_id", "n_shingles", "set_key").join(spread, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    rows_of = named.select("doc_id", "n_shingles", component.alias("component_id"))
    return rows_of.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each component of near-duplicates, the one with the smallest doc_id, and all columns.

    Of rows that repeat a kept doc_id one stays, the least by a hash of the
    whole row. Rows with a null doc_id stay.
    """
    gone, key, mark, least = (free_name(docs, n) for n in ("_gone", "_key", "_mark", "_least"))
    found = near_duplicates(docs, **options).where(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    # maps have no hash; as JSON they have
    told = [F.to_json(F.col(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in docs.schema.fields]
    left = docs.join(found, F.col("doc_id") == F.col(gone), "left_anti").withColumn(mark, F.xxhash64(*told))
    repeated = left.where("doc_id is not null").groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias(gone), F.min(mark).alias(least)).where(F.col(gone) > 1)
    repeated = materialize(repeated.select(key, least), "repeated")
    if repeated.limit(1).count():
        left = left.join(repeated, F.col("doc_id") == F.col(key), "left")
        first = left.where(F.col(mark) == F.col(least)).dropDuplicates(["doc_id"])
        left = left.where(F.col(least).isNull()).unionByName(first)
    return left.select(*docs.columns)


#: All pairs that share a shingle, on the whole table.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
      HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT doc_id AS n, doc_id AS m FROM documents UNION SELECT r.n, l.b FROM r JOIN l ON r.m = l.a),
c AS (SELECT n, min(m) AS component_id FROM r GROUP BY n)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c ON c.n = s.doc_id
"""
