"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per shard.

Distinct vectors are dealt to shards by hash; each shard's graph is built in one
task, layer by layer, points joining in batches that are at most as large as
what is there. Every vector then queries every shard: a beam search down the
layers, then a flood over the found links' neighbours, so a vector has all its
links however many they are. In each task and shard some queries are compared to
brute force; while recall is short, the beam is doubled and the task's queries
searched again. Links are confirmed by cosine in double precision. Of the links
of a slice of queries a task keeps the counts and a spanning forest, never all
pairs; the forests' union has the components of the links.

Exact copies of a vector enter once, with their number.
"""

from __future__ import annotations

import math
import pickle
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import materialize, scratch_path
from .textcore import give_back

NEIGHBORS = 12
LAYER_SHARE = 16
SHARD_ROWS = 32768
LEAST_SHARDS = 6
QUERY_ROWS = 8192
SLICE = 128


def _order_hash(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spread_out(unit: np.ndarray, rows: np.ndarray, near: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """At most most neighbours for each row of near (-1: none), sorted by sims: first those closer to the row than to any taken one, then the rest."""
    count, width = near.shape
    vectors = unit[np.maximum(near, 0)]
    between = np.einsum("bid,bjd->bij", vectors, vectors)
    taken = np.zeros((count, width), bool)
    for k in range(width):
        blocked = np.where(taken, between[:, k], -2.0).max(axis=1) > sims[:, k] if k else np.zeros(count, bool)
        taken[:, k] = (near[:, k] >= 0) & ~blocked & (taken.sum(axis=1) < most)
    rank = np.where(taken, 0, np.where(near >= 0, 1, 2)) * width + np.arange(width)
    pick = np.argsort(rank, axis=1)[:, :most]
    return np.take_along_axis(near, pick, axis=1)


class Layer:
    """Neighbour lists among the points nodes of unit; -1 fills them up."""

    def __init__(self, unit: np.ndarray, nodes: np.ndarray, upper: Layer | None, lists: np.ndarray | None = None):
        self.nodes, self.upper = nodes, upper
        self.local = unit[nodes]
        self.up = np.zeros(0, np.int32) if upper is None else np.searchsorted(nodes, upper.nodes).astype(np.int32)
        self.lists = np.full((len(nodes), 2 * NEIGHBORS), -1, np.int32) if lists is None else lists
        self.ready = np.full(len(nodes), lists is not None)

    def build(self, beam: int) -> Layer:
        nodes, upper = self.nodes, self.upper
        size = min(len(nodes), 64)
        order = np.argsort(_order_hash(nodes))
        if upper is not None:  # points of the upper layer first, so that entries exist
            order = np.concatenate([self.up, order[~np.isin(order, self.up)]])
            size = min(len(nodes), max(size, len(self.up)))
        done = 0
        while done < len(order):
            batch = order[done : done + (min(size, 64) if not done else min(done, 1024))]
            self._join(batch, beam)
            self.ready[batch] = True
            done += len(batch)
        return self

    def _join(self, batch: np.ndarray, beam: int) -> None:
        inner = self.local[batch] @ self.local[batch].T
        np.fill_diagonal(inner, -2.0)
        width = min(len(batch), beam)
        near = np.argpartition(-inner, width - 1, axis=1)[:, :width] if len(batch) > 1 else np.zeros((1, 1), int)
        sims, near = np.take_along_axis(inner, near, axis=1), batch[near].astype(np.int32)
        if self.ready.any():
            found = [self.search(self.local[batch[a : a + SLICE]], beam)[:2] for a in range(0, len(batch), SLICE)]
            near = np.concatenate([near, np.concatenate([f[0] for f in found])], axis=1)
            sims = np.concatenate([sims, np.concatenate([f[1] for f in found])], axis=1)
        near = np.where(sims > -1.5, near, -1)
        order = np.argsort(-sims, axis=1)[:, :beam]
        near, sims = np.take_along_axis(near, order, axis=1), np.take_along_axis(sims, order, axis=1)
        mine = spread_out(self.local, batch, near, sims, NEIGHBORS)
        self.lists[batch, : mine.shape[1]] = mine
        self._link_back(batch, mine)

    def _link_back(self, batch: np.ndarray, mine: np.ndarray) -> None:
        to = mine.ravel()
        source = np.repeat(batch, mine.shape[1])[to >= 0]
        to = to[to >= 0]
        if not len(to):
            return  # a layer's only point so far
        hosts = np.unique(to)
        old = self.lists[hosts]
        to = np.concatenate([to, np.repeat(hosts, old.shape[1])[old.ravel() >= 0]])
        source = np.concatenate([source, old.ravel()[old.ravel() >= 0]])
        pair = np.unique(to.astype(np.int64) * len(self.nodes) + source)
        to, source = pair // len(self.nodes), pair % len(self.nodes)
        sims = np.concatenate(
            [np.einsum("nd,nd->n", self.local[to[a : a + 65536]], self.local[source[a : a + 65536]]) for a in range(0, len(to), 65536)]
        )
        order = np.lexsort([-sims, to])
        to, source, sims = to[order], source[order], sims[order]
        place = np.arange(len(to)) - np.searchsorted(to, to)
        width = 2 * NEIGHBORS
        keep = place < 2 * width
        row = np.searchsorted(hosts, to[keep])
        near = np.full((len(hosts), 2 * width), -1, np.int32)
        close = np.full((len(hosts), 2 * width), -2.0, np.float32)
        near[row, place[keep]], close[row, place[keep]] = source[keep], sims[keep]
        full = (near >= 0).sum(axis=1) > width
        out = near[:, :width].copy()
        for a in range(0, len(hosts), SLICE):
            some = np.flatnonzero(full[a : a + SLICE]) + a
            if len(some):
                out[some] = spread_out(self.local, hosts[some], near[some], close[some], width)
        self.lists[hosts] = out

    def entries(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """Good starting points (places in nodes) for each query."""
        if self.upper is None or not self.ready[self.up].any():
            ready = np.flatnonzero(self.ready)[:256]
            sims = queries @ self.local[ready].T
            return ready[np.argsort(-sims, axis=1)[:, :4]]
        found = self.upper.search(queries, max(4, beam // 4))[0][:, :4]
        return np.where(found >= 0, self.up[np.maximum(found, 0)], -1)

    def search(self, queries: np.ndarray, beam: int, close: float | None = None):
        """Places and similarities of the beam closest nodes of each query, best first, then (query, place) of all seen with similarity close at least."""
        count, n = len(queries), len(self.nodes)
        seen, grown = np.zeros(count * n, bool), np.zeros(count * n, bool)
        best = np.full((count, beam), -1, np.int64)
        sims = np.full((count, beam), -2.0, np.float32)
        hits: list[np.ndarray] = []

        def look(rows, places):
            """Similarities of the pairs not seen before."""
            key = np.unique(rows.astype(np.int64) * n + places)
            key = key[~seen[key]]
            seen[key] = True
            rows, places = key // n, key % n
            value = np.concatenate(
                [np.zeros(0, np.float32)]
                + [np.einsum("nd,nd->n", queries[rows[a : a + 65536]], self.local[places[a : a + 65536]]) for a in range(0, len(key), 65536)]
            )
            if close is not None:
                hits.append(key[value >= close])
            return rows, places, value

        def merge(rows, places, value):
            use = value > sims[rows, -1]
            rows, places, value = rows[use], places[use], value[use]
            if not len(rows):
                return
            order = np.lexsort([-value, rows])
            rows, places, value = rows[order], places[order], value[order]
            at = np.arange(len(rows)) - np.searchsorted(rows, rows)
            use = at < beam
            touched = np.unique(rows)
            width = min(beam, int(at.max()) + 1)
            new, score = np.full((len(touched), width), -1, np.int64), np.full((len(touched), width), -2.0, np.float32)
            row = np.searchsorted(touched, rows[use])
            new[row, at[use]], score[row, at[use]] = places[use], value[use]
            both, scores = np.concatenate([best[touched], new], axis=1), np.concatenate([sims[touched], score], axis=1)
            pick = np.argsort(-scores, axis=1)[:, :beam]
            best[touched], sims[touched] = np.take_along_axis(both, pick, axis=1), np.take_along_axis(scores, pick, axis=1)

        start = self.entries(queries, beam)
        rows = np.repeat(np.arange(count), start.shape[1])
        fits = start.ravel() >= 0
        merge(*look(rows[fits], start.ravel()[fits]))
        live = np.arange(count)
        while len(live):
            key = live[:, None] * n + best[live]
            fresh = (best[live] >= 0) & ~grown[np.where(best[live] >= 0, key, 0)]
            first = np.cumsum(fresh, axis=1)
            fresh &= first <= 4
            some = first[:, -1] > 0
            live = live[some]
            key = key[some][fresh[some]]
            if not len(key):
                break
            grown[key] = True
            rows, lists = key // n, self.lists[key % n]
            fits = lists.ravel() >= 0
            merge(*look(np.repeat(rows, lists.shape[1])[fits], lists.ravel()[fits].astype(np.int64)))
        while close is not None and hits:  # the flood
            key = np.concatenate(hits)
            front = key[~grown[key]]
            if not len(front):
                break
            grown[front] = True
            for a in range(0, len(front), 16384):
                part = front[a : a + 16384]
                lists = self.lists[part % n]
                fits = lists.ravel() >= 0
                look(np.repeat(part // n, lists.shape[1])[fits], lists.ravel()[fits].astype(np.int64))
        found = np.concatenate([np.zeros(0, np.int64), *hits])
        return best, sims, found // n, found % n


class Graph:
    """A shard's points: their ids, numbers of copies and vectors, and layers."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray, layers: list | None = None, beam: int = 32):
        self.ids, self.copies, self.vectors = ids, copies, vectors
        unit = vectors.astype(np.float64)
        self.unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
        self.base = None
        if layers is not None:
            for nodes, lists in layers:
                self.base = Layer(self.unit, nodes, self.base, lists)
            return
        level = np.floor(-np.log((_order_hash(ids) >> np.uint64(11)).astype(float) / 2**53 + 1e-18) / math.log(LAYER_SHARE)).astype(int)
        for k in range(int(level.max()), -1, -1):
            nodes = np.flatnonzero(level >= k)
            if k < 2 or len(nodes) >= 2 * NEIGHBORS:
                self.base = Layer(self.unit, nodes, self.base).build(beam)

    def dumps(self) -> bytes:
        layers, layer = [], self.base
        while layer is not None:
            layers.insert(0, (layer.nodes, layer.lists))
            layer = layer.upper
        return pickle.dumps((self.ids, self.copies, self.vectors, layers))

    @classmethod
    def loads(cls, data: bytes) -> Graph:
        return cls(*pickle.loads(data))

    def links(self, queries: Queries, threshold: float, beam: int):
        """(query, place) of found pairs of other ids with cosine at least threshold in double precision, a slice of queries at a time."""
        for a in range(0, len(queries.ids), SLICE):
            _, _, row, place = self.base.search(queries.unit[a : a + SLICE], beam, threshold - 1e-4)
            yield self._confirmed(queries, row + a, place, threshold)

    def exact(self, queries: Queries, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """The same by brute force."""
        row, place = np.nonzero(queries.unit @ self.unit.T >= threshold - 1e-4)
        return self._confirmed(queries, row, place, threshold)

    def _confirmed(self, queries: Queries, row: np.ndarray, place: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        other = queries.ids[row] != self.ids[place]
        row, place = row[other], place[other]
        value = np.zeros(len(row))
        for a in range(0, len(row), 65536):
            r, p = row[a : a + 65536], place[a : a + 65536]
            mine = self.vectors[p].astype(np.float64)
            value[a : a + 65536] = np.einsum("nd,nd->n", queries.double[r], mine) / (queries.norm[r] * np.linalg.norm(mine, axis=1))
        keep = value >= threshold
        return row[keep], place[keep]

    def planted(self, count: int, threshold: float) -> Queries:
        """Queries that have links for certain: stored vectors turned by angles up to the threshold's, under ids of their own."""
        at = np.argsort(_order_hash(self.ids))[:count]
        rng = np.random.default_rng(np.bitwise_xor.reduce(self.ids.view(np.uint64)))
        unit = self.unit[at].astype(np.float64)
        noise = rng.normal(size=unit.shape)
        noise -= (noise * unit).sum(1, keepdims=True) * unit
        size = np.linalg.norm(noise, axis=1, keepdims=True)
        cosine = np.where(size > 1e-9, threshold + (1 - threshold) * rng.uniform(0.05, 0.95, size.shape), 1.0)
        return Queries(~self.ids[at], cosine * unit + np.sqrt(1 - cosine**2) * noise / np.maximum(size, 1e-9))

    def audited_links(self, queries: Queries, threshold: float, beam: int, audited: int, recall: float) -> Found:
        """Links of all queries, with the beam doubled until those of audited ones are found to the share recall.

        Audited are the first queries by hash, the first of those that have
        found a link, and as many planted ones, whose links are there for
        certain; so an audit is never empty where the shard has a vector. All
        three groups together, and the planted ones alone, must reach the share.
        """
        order = np.argsort(_order_hash(queries.ids))
        sure = self.planted(audited, threshold)
        sure_truth = np.unique(self._pairs(*self.exact(sure, threshold)))
        checked = None
        while True:
            found = Found(queries, self)
            for row, place in self.links(queries, threshold, beam):
                found.add(row, place)
            if checked is None:
                checked = queries.take(np.union1d(order[:audited], order[found.count[order] > 0][:audited]))
                truth = self._pairs(*self.exact(checked, threshold))
            hits, sure_hits = self._found(checked, truth, threshold, beam), self._found(sure, sure_truth, threshold, beam)
            if beam >= len(self.ids) or (sure_hits >= recall * len(sure_truth) and hits + sure_hits >= recall * (len(truth) + len(sure_truth))):
                found.audit = np.array([len(truth) + len(sure_truth), hits + sure_hits])
                return found
            beam *= 2

    def _found(self, queries: Queries, truth: np.ndarray, threshold: float, beam: int) -> int:
        """How many of the true pairs of the queries a search finds."""
        return sum(int(np.isin(truth, self._pairs(*pairs)).sum()) for pairs in self.links(queries, threshold, beam))

    def _pairs(self, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.asarray(row, np.int64) * len(self.ids) + place


class Queries:
    """Ids, vectors in double precision with their norms, and unit vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.double = ids, vectors.astype(np.float64)
        self.norm = np.linalg.norm(self.double, axis=1)
        self.unit = (self.double / self.norm[:, None]).astype(np.float32)

    def take(self, rows: np.ndarray) -> Queries:
        return Queries(self.ids[rows], self.double[rows])


class Found:
    """What is kept of the links of queries in a shard: their counts, a spanning forest, and the audit (true links, found ones)."""

    def __init__(self, queries: Queries, graph: Graph):
        self.queries, self.graph = queries, graph
        self.count = np.zeros(len(queries.ids), np.int64)
        self.node, self.root = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.audit = np.zeros(2, np.int64)

    def add(self, row: np.ndarray, place: np.ndarray) -> None:
        if len(row):
            self.count += np.bincount(row, self.graph.copies[place], len(self.count)).astype(np.int64)
            self.join(self.queries.ids[row], self.graph.ids[place])

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        node, root = forest(np.concatenate([self.node, a]), np.concatenate([self.root, b]))
        self.node, self.root = node[node != root], root[node != root]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node reachable) with the components of edges a-b."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _stack(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def search_links(points: DataFrame, threshold: float, shards: int, beam: int = 24, audited: int = 32, recall: float = 0.999) -> DataFrame:
    """Rows (id, links, other, true, hits) from points(id, copies, v): counts of linked vectors, copies included (other null), forest
    edges (links null), and audits (id null): the true links of audited queries and those found.

    A graph is a file of its own in the shared folder; a task holds some of the
    queries and one graph at a time. In each graph it checks audited queries by
    brute force.
    """
    folder = scratch_path(points.sparkSession, "graphs")

    def build(table: pa.Table) -> pa.Table:
        graph = Graph(table["id"].to_numpy(), table["copies"].to_numpy(), _stack(table["v"]))
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        path = f"{root}/{table['shard'][0].as_py():06d}-{uuid.uuid4().hex}"  # a task that runs again leaves another file; only named ones are read
        with fs.open_output_stream(path) as out:
            out.write(graph.dumps())
        return pa.table({"shard": table["shard"][:1], "path": pa.array([path])})

    dealt = points.withColumn("shard", F.pmod(F.xxhash64("id"), shards).cast("int"))
    graphs = materialize(dealt.groupBy("shard").applyInArrow(build, "shard int, path string"), "graphs")
    paths = [r["path"] for r in graphs.collect()]  # a name for each SHARD_ROWS vectors

    def run(batches):
        tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.concat_tables(tables)
        queries = Queries(table["id"].to_numpy(), _stack(table["v"]))
        fs, _ = pafs.FileSystem.from_uri(folder)
        total, whole = np.zeros(len(queries.ids), np.int64), Found(queries, None)
        for path in paths:
            with fs.open_input_file(path) as file:
                found = Graph.loads(file.read()).audited_links(queries, threshold, beam, audited, recall)
            total += found.count
            whole.join(found.node, found.root)
            whole.audit += found.audit
        some = np.flatnonzero(total)
        rows = ((queries.ids[some], total[some], None, None, None), (whole.node, None, whole.root, None, None), (None, None, None, *whole.audit[:, None]))
        for columns in rows:
            size = next(len(c) for c in columns if c is not None)
            yield pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in columns], ["id", "links", "other", "true", "hits"])
        give_back()

    cores = points.sparkSession.sparkContext.defaultParallelism
    parts = max(2 * cores, math.ceil(points.count() / QUERY_ROWS))
    return points.select("id", "v").repartition(parts, "id").mapInArrow(run, "id long, links long, other long, true long, hits long")


def link_embeddings(vectors: DataFrame, threshold: float = 0.9, shards: int | None = None, with_recall: bool = False, **search) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors(vec_id, embedding).

    with_recall adds audit_recall: the share of the audited queries' true links
    that the search has found, of the whole table, null if they have none.
    Vectors that are null, empty or zero, or hold a null or a non-finite
    component, link with nothing; so do vectors of different lengths with each
    other, which are searched apart by length. A row with a null vec_id links
    with nothing, has a null component and is kept. Rows that repeat a vec_id
    with the same vector count once; with different vectors, each links by
    itself. Other columns are ignored. An empty table gives no rows.

    Points are known by a 64-bit hash of id and vector; two of them are taken
    for one with a chance near 2**-64.
    """
    exact = vectors.schema["embedding"].dataType.elementType.simpleString()
    v = F.col("embedding") if exact in ("float", "double") else F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = rows.withColumn("key", F.when(usable, F.xxhash64("v")))
    good = rows.where("key is not null")
    points = good.groupBy("key", "v").agg(F.min("vec_id").alias("vec_id"), F.count_distinct("vec_id").alias("copies"))
    points = materialize(points.select("key", "v", "vec_id", "copies", F.xxhash64("vec_id", "v").alias("id")), "points")
    sizes = points.groupBy(F.size("v").alias("d")).count().collect()
    found = None
    for size in sizes:
        some = points.where(F.size("v") == size["d"])
        count = shards or max(LEAST_SHARDS, math.ceil(size["count"] / SHARD_ROWS))
        got = search_links(some.select("id", "copies", "v"), threshold, count, **search)
        found = got if found is None else found.union(got)
    if found is None:
        out = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        recall = None
    else:
        found = materialize(found, "links")
        counts = found.where("links is not null").groupBy("id").agg(F.sum("links").alias("links"))
        labels = materialize(connected_components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))), "labels")
        labels = labels.select(F.col("node").alias("id"), F.col("component").alias("label"))
        least = points.select("id", "vec_id").join(labels, "id").groupBy("label").agg(F.min("vec_id").alias("component"))
        told = (
            points.join(counts, "id", "left").join(labels.join(least, "label"), "id", "left")
            .select("key", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "vec_id").alias("c"))
        )
        both = rows.join(told.withColumnsRenamed({"key": "_key", "v": "_v"}), (F.col("key") == F.col("_key")) & (F.col("v") == F.col("_v")), "left")
        out = both.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
        recall = found.agg(F.try_divide(F.sum("hits"), F.sum("true")).alias("audit_recall"))
    out = out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    if not with_recall:
        return out
    return out.crossJoin(F.broadcast(recall)) if recall is not None else out.withColumn("audit_recall", F.lit(None).cast("double"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS n, vec_id AS m FROM v UNION SELECT r.n, l.b FROM r JOIN l ON r.m = l.a),
c AS (SELECT n AS vec_id, min(m) AS component_id FROM r GROUP BY n)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c USING (vec_id)
"""
