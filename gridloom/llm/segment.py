"""SentencePiece segmentations sampled without replacement by Gumbel top-k.

A text's segmentations are the paths of a lattice of pieces. A backward pass
gives the mass behind each position, so a path can be drawn piece by piece with
its exact probability. Perturbing the mass of a prefix by Gumbel noise, top
down, gives every set of paths the noise of its best member; that bound is
exact, so an A-star search that always opens the best set emits paths in the
order of their noise: k distinct paths, sampled without replacement. The noise
of the best set left, kappa, turns a path's probability p into the chance
1 - exp(-p exp(-kappa)) that it was included.

Lattices fall apart between two characters that stand side by side in no
piece, as a visible one and a following space do, or a letter and most stops.
So equal parts share one lattice, that of a part met again stays with the
worker, and all of a block's parts are walked at once. The best path of a set draws each piece freely, which
is why whole paths can be drawn in parallel. Random numbers are hashes of the
row's key, the path's number and the position, so results don't depend on how
rows are dealt out.

Decoding joins the bytes of the pieces and drops the space put in front.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import blocks, mix, span_hashes, utf8

SPACE = 32
#: Sets of siblings whose mass is under e**SURE of the text's are opened only where too few others are left; that one of them had been
#: among the best k has a chance below k * places * e**(SURE / 2), about e**-80 for a text of a million places.
SURE = -200.0
ALPHA = 0.3
BLOCK = 1 << 18
#: Edges that a lattice keeps before it begins anew (24 bytes each), slots of its table of parts, and of that of parts seen before.
KEPT, SLOTS, SEEN = 1 << 20, 1 << 18, 1 << 22
#: Vocabularies of this worker by model file.
_HELD: dict[str, Vocabulary] = {}


class Vocabulary:
    """Pieces as bytes, their log-probabilities, and a hashed trie over them.

    A model with probabilities gives its own. One that only ranks its pieces
    (byte-pair encoding) gives the Zipf law of the ranks; bytes come last. Both are
    flattened by the power alpha, as usual for subword regularisation.
    """

    def __init__(self, model_file: str, alpha: float = ALPHA):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        count = sp.get_piece_size()
        score = np.array([sp.get_score(i) for i in range(count)])
        self.pieces: list[bytes] = []
        usable = np.zeros(count, bool)
        self.byte_id = np.full(256, -1)
        for i in range(count):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.pieces.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.pieces.append(b"")
            else:
                usable[i] = True
                self.pieces.append(piece.replace("▁", " ").encode())
        if (self.byte_id < 0).any():
            raise ValueError("a model with byte fallback is needed")
        ranks = score[usable]
        by_rank = len(ranks) > 1 and (ranks == np.round(ranks)).all() and ranks.min() < -1000
        self.log_p = np.full(count, -np.inf)
        if by_rank:
            order = np.argsort(np.argsort(-ranks))
            self.log_p[usable] = -np.log(order + 2.7)
            self.log_p[self.byte_id] = -np.log(usable.sum() + 2.7)
        else:
            self.log_p[usable] = ranks
            self.log_p[self.byte_id] = ranks.min() - 10.0
        held = self.log_p > -np.inf
        self.log_p[held] = alpha * (self.log_p[held] - np.log(np.exp(self.log_p[held]).sum()))
        self.bytes = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(p) for p in self.pieces])])
        joined = np.zeros(1 << 16, bool)
        edges: dict[tuple[int, int], int] = {}
        self.piece_of = [-1]
        for i in np.flatnonzero(usable):
            piece = self.pieces[i]
            if b" " in piece.lstrip(b" "):
                raise ValueError("a piece goes on behind a space")
            joined[[a << 8 | b for a, b in itertools.pairwise(piece)]] = True
            node = 0
            for b in piece:
                if (node, b) not in edges:
                    edges[node, b] = len(self.piece_of)
                    self.piece_of.append(-1)
                node = edges[node, b]
            self.piece_of[node] = int(i)
        self.piece_of = np.array(self.piece_of)
        self.apart = ~joined  # pairs of bytes that are in no piece
        self.bits = 3 + int(np.ceil(np.log2(len(edges) + 1)))
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_node = np.zeros(1 << self.bits, np.int32)
        for (node, b), to in edges.items():
            key = node * 256 + b
            slot = (key * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - self.bits)
            while self.slot_key[slot] != -1:
                slot = (slot + 1) % (1 << self.bits)
            self.slot_key[slot], self.slot_node[slot] = key, to

    @classmethod
    def of_worker(cls, model_file: str) -> Vocabulary:
        """One vocabulary for the life of a Python worker, with its lattice, so tasks find the parts that earlier ones met again."""
        if model_file not in _HELD:
            _HELD[model_file] = cls(model_file)
            _HELD[model_file].lattice = Lattice(_HELD[model_file])
        return _HELD[model_file]

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Next trie nodes; -1 where there is none."""
        key = nodes.astype(np.int64) * 256 + letters
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.slot_key[slot] == key, self.slot_node[slot], -1)
        open_ = np.flatnonzero((out < 0) & (self.slot_key[slot] >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            hit = self.slot_key[slot[open_]] == key[open_]
            out[open_[hit]] = self.slot_node[slot[open_[hit]]]
            open_ = open_[~hit & (self.slot_key[slot[open_]] >= 0)]
        return out


class Lattice:
    """Edges of distinct parts: target, piece, log chance, running chance, from the first of each position on.

    Parts lie one after the other, each followed by a final position. The edges
    from a position stand in falling order of chance. Parts that a second block
    brings stay, found by their hashes in a table of slots; those of one block
    alone go with the next block, whose edges take their place.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.seen = np.zeros(SEEN, bool)
        self.clear()

    def clear(self) -> None:
        self.known, self.root = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int64)
        self.dst, self.piece, self.log_q, self.running = (np.zeros(0, t) for t in (np.int32, np.int32, float, float))
        self.first, self.final = np.zeros(1, np.int32), np.zeros(0, bool)
        self.nodes = self.edges = 0

    def roots(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """First position of each part's lattice, until the next call."""
        if max(self.edges, len(self.dst) // 2) > KEPT:  # or a very long part has taken much room
            self.clear()
        hashes = span_hashes(data, starts, ends)
        slots = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        root = self.root[slots]
        new = np.flatnonzero(self.known[slots] != hashes)
        fresh, shown, which = np.unique(hashes[new], return_index=True, return_inverse=True)
        bits = (fresh & np.uint64(SEEN - 1)).astype(np.int64)
        again = self.seen[bits]
        if np.count_nonzero(self.seen[::64]) * 128 > SEEN:
            self.seen[:] = False
        self.seen[bits] = True
        order = np.argsort(~again, kind="stable")
        some = new[shown[order]]
        at = self._build(data, starts[some], ends[some])
        place = np.zeros(len(fresh), np.int64)
        place[order] = at[:-1]
        root[new] = place[which]
        self.nodes = int(at[np.count_nonzero(again)])
        self.edges = int(self.first[self.nodes])
        kept = fresh[again]
        slots = (kept & np.uint64(SLOTS - 1)).astype(np.int64)
        self.known[slots] = kept
        first = self.known[slots] == kept  # of two in one slot the one that is there
        self.root[slots[first]] = place[again][first]
        return root

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        """values into an array from at on, with room made for more."""
        held = getattr(self, name)
        if at + len(values) > len(held):
            held = np.concatenate([held[:at], np.zeros(len(values) + max(at // 2, 1 << 18), held.dtype)])
            setattr(self, name, held)
        held[at : at + len(values)] = values

    def _build(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Adds the lattices of parts behind what stays; their first positions, and the one behind the last."""
        vocabulary, size = self.vocabulary, ends - starts
        root = np.concatenate([[0], np.cumsum(size + 1)])
        total = int(root[-1])
        offset = np.arange(total) - np.repeat(root[:-1], size + 1)
        left = np.repeat(size, size + 1) - offset
        inner = left > 0
        text = np.zeros(total, np.uint8)
        text[inner] = data[(np.repeat(starts, size + 1) + offset)[inner]]
        head = inner & ((text & 0xC0) != 0x80)
        where, depth = np.flatnonzero(head), 0
        node = np.zeros(len(where), np.int32)
        width = np.array([1] * 0xC0 + [2] * 0x20 + [3] * 0x10 + [4] * 0x10)[text]
        count, known = np.zeros(total, np.int64), np.zeros(total, bool)
        src, dst, piece, rank = [], [], [], []
        while len(where):
            fits = left[where] > depth
            where, node = where[fits], node[fits]
            node = vocabulary.step(node, text[where + depth])
            fits = node >= 0
            where, node = where[fits], node[fits]
            depth += 1
            found = vocabulary.piece_of[node]
            full = found >= 0
            at = where[full]
            src.append(at), dst.append(at + depth), piece.append(found[full]), rank.append(count[at])
            count[at] += 1
            known[at[width[at] == depth]] = True
        char = np.maximum.accumulate(np.where(head | ~inner, np.arange(total), 0))
        lone = np.flatnonzero(inner & ~known[char])
        src, dst, piece, rank = (np.concatenate(c) for c in ([*src, lone], [*dst, lone + 1], [*piece, vocabulary.byte_id[text[lone]]], [*rank, count[lone]]))
        count[lone] += 1
        log_p = vocabulary.log_p[piece]
        mass = np.full(total, -np.inf)
        mass[root[1:] - 1] = 0.0
        near = np.flatnonzero(count)  # positions with edges, by how far their part's end is, and their edges together
        far = left[near]
        near = near[np.argsort(far.astype(np.uint16) if far.max(initial=0) < 1 << 16 else far, kind="stable")]
        begin = np.concatenate([[0], np.cumsum(count[near])])
        of = np.zeros(total, np.int64)
        of[near] = begin[:-1]
        place = of[src] + rank
        to, log_to = np.zeros(len(src), np.int64), np.zeros(len(src))
        to[place], log_to[place] = dst, log_p
        cuts = np.flatnonzero(np.diff(left[near], prepend=0, append=-1))
        for a, b in itertools.pairwise(cuts.tolist()):
            x, y = begin[a], begin[b]
            mass[near[a:b]] = np.logaddexp.reduceat(log_to[x:y] + mass[to[x:y]], begin[a:b] - x)
        log_q = log_p + mass[dst] - mass[src]
        order = np.argsort((src << 30) | (np.minimum(-log_q * 65536, (1 << 24) - 1).astype(np.int64) << 6) | np.minimum(rank, 63))
        log_q = log_q[order]
        first = np.concatenate([[0], np.cumsum(count)])
        running = np.exp(log_q)
        more, k = np.flatnonzero(count > 1), 1
        while len(more):
            at = first[more] + k
            running[at] += running[at - 1]
            k += 1
            more = more[count[more] > k]
        for name, values in (("dst", dst[order] + self.nodes), ("piece", piece[order]), ("log_q", log_q), ("running", running)):
            self._put(name, self.edges, values)
        self._put("first", self.nodes, first + self.edges)
        self._put("final", self.nodes, ~inner)
        return root + self.nodes

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        edge = self.first[node].astype(np.int64)
        last = self.first[node + 1] - 1
        going = np.flatnonzero((self.running[edge] < u) & (edge < last))
        while len(going):
            edge[going] += 1
            going = going[(self.running[edge[going]] < u[going]) & (edge[going] < last[going])]
        return edge


def uniform(seed: np.ndarray, path: int, position: np.ndarray) -> np.ndarray:
    """In (0, 1), by key, path and position."""
    x = mix(seed + np.uint64((path + 1) * 0x9FB21C651E98DF25 % (1 << 64)) + position.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


class Sampler:
    """Draws paths for one block, before lattice (of its own, or the worker's) is given to the next."""

    def __init__(self, vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray, lattice: Lattice | None = None):
        full = np.flatnonzero(np.diff(offsets))
        self.data = np.insert(data, offsets[:-1][full], SPACE)
        self.offsets = offsets + np.searchsorted(full, np.arange(len(offsets)))
        self.seeds, self.lattice = seeds, lattice or Lattice(vocabulary)
        data = self.data
        n = len(data)
        cut = np.zeros(n, bool)
        cut[1:] = vocabulary.apart[(data[:-1].astype(np.uint16) << 8) | data[1:]] & ((data[1:] & 0xC0) != 0x80)
        cut[self.offsets[:-1][full]] = True
        self.starts = np.flatnonzero(cut)
        ends = np.append(self.starts[1:], n)[: len(self.starts)]
        self.doc = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.roots = self.lattice.roots(data, self.starts, ends) if n else np.zeros(0, np.int64)

    def walk(self, path: int, places: np.ndarray, nodes: np.ndarray, docs: np.ndarray, out: np.ndarray) -> None:
        """Draw edges from nodes at places on to the end of each part, into out (edge by place)."""
        lattice = self.lattice
        while len(places):
            edge = lattice.draw(nodes, uniform(self.seeds[docs], path, places - self.offsets[docs]))
            out[places] = edge
            new = lattice.dst[edge]
            places = places + (new - nodes)
            going = ~lattice.final[new]
            places, nodes, docs = places[going], new[going], docs[going]

    def sample(self, k: int):
        """Per path: edges by place (-1 between), and per document log_p and gumbel; then kappa per document."""
        self.k = k
        n_docs = len(self.offsets) - 1
        none = np.full(n_docs, -np.inf)
        if not len(self.data):
            return [(np.zeros(0, np.int64), np.zeros(n_docs), none)], none
        paths, heaps = [], [[] for _ in range(n_docs)]
        edges = np.full(len(self.data), -1, np.int64)
        self.walk(0, self.starts, self.roots, self.doc, edges)
        gumbel = -np.log(-np.log(uniform(self.seeds, 0, np.full(n_docs, 1 << 40))))
        gumbel[np.diff(self.offsets) == 0] = -np.inf
        kappa = none.copy()
        for path in range(k):
            log_p = self._note(path, edges, gumbel, heaps, since=None if not path else self.since)
            paths.append((edges, log_p, gumbel))
            best = [max(h) if h else None for h in heaps]
            if path == k - 1:
                kappa = np.array([b[0] if b else -np.inf for b in best])
                break
            edges, gumbel = self._branch(path + 1, best, heaps, paths)
        return paths, kappa

    def _note(self, path: int, edges: np.ndarray, gumbel: np.ndarray, heaps: list, since) -> np.ndarray:
        """Log-probabilities of a path; puts its sets of siblings on the heaps, from place since of each document on."""
        lattice = self.lattice
        place = np.flatnonzero(edges >= 0)
        edge = edges[place]
        log_q = lattice.log_q[edge]
        first = np.searchsorted(place, self.offsets)
        sums = np.append(0.0, np.cumsum(log_q))
        log_p = sums[first[1:]] - sums[first[:-1]]
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        prefix = sums[:-1] - sums[first[:-1]][doc]
        self._push(path, place, edge, log_q, doc, prefix, gumbel, heaps, since, prefix > SURE)
        short = np.array([not h or max(h)[0] < SURE / 2 for h in heaps]) & (np.diff(first) > 0)
        if short.any():
            self._push(path, place, edge, log_q, doc, prefix, gumbel, heaps, since, (prefix <= SURE) & short[doc])
        return log_p

    def _push(self, path, place, edge, log_q, doc, prefix, gumbel, heaps, since, use):
        keep = self.k
        if since is not None:
            use = use & (place >= since[doc])
        use = use & (log_q < -1e-12) & (gumbel[doc] > -np.inf)
        at = np.flatnonzero(use)
        place, doc = place[at], doc[at]
        rest = prefix[at] + np.log(-np.expm1(log_q[at]))
        noise = np.log(-np.log(uniform(self.seeds[doc], path + 1000, place - self.offsets[doc])))
        bound = -np.logaddexp(-gumbel[doc], noise - rest)
        order = np.lexsort([-bound, doc])
        rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
        for j in order[rank < keep].tolist():
            heaps[doc[j]].append((float(bound[j]), int(place[j]), path, (int(edge[at[j]]),), float(prefix[at[j]])))

    def _branch(self, path: int, best: list, heaps: list, paths: list):
        """The next path of each document: opens its best set, takes a sibling and draws on from there."""
        lattice = self.lattice
        gumbel = np.full(len(best), -np.inf)
        self.since = np.zeros(len(best), np.int64)
        edges = np.full(len(self.data), -1, np.int64)
        go = []
        for doc, head in enumerate(best):
            if head is None:
                continue
            bound, place, parent, shut, prefix = head
            heaps[doc].remove(head)
            some = paths[parent][0]
            a, b = self.offsets[doc], self.offsets[doc + 1]
            edges[a:place] = some[a:place]
            part = np.searchsorted(self.starts, place, "right") - 1
            node = int(self.roots[part] + place - self.starts[part])
            open_ = [e for e in range(lattice.first[node], lattice.first[node + 1]) if e not in shut and lattice.log_q[e] > -np.inf]
            chance = np.exp(lattice.log_q[open_])
            u = uniform(self.seeds[doc : doc + 1], path + 2000, np.array([place - a]))[0]
            chosen = open_[min(int(np.searchsorted(np.cumsum(chance), u * chance.sum(), "right")), len(open_) - 1)]
            edges[place] = chosen
            left = chance.sum() - np.exp(lattice.log_q[chosen])
            if len(open_) > 1 and left > 0:
                u = uniform(self.seeds[doc : doc + 1], path + 3000, np.array([place - a]))[0]
                new = -np.logaddexp(-bound, np.log(-np.log(u)) - prefix - np.log(left))
                heaps[doc].append((float(new), place, parent, (*shut, chosen), prefix))
            gumbel[doc] = bound
            target = int(lattice.dst[chosen])
            self.since[doc] = place + 1
            if not lattice.final[target]:
                go.append((place + target - node, target, doc))
            if part + 1 < len(self.starts) and self.starts[part + 1] < b:
                to = np.searchsorted(self.starts, b)
                go += [(int(self.starts[part + 1]), int(to), -1 - doc)]
        near = [g for g in go if g[2] >= 0]
        spans = [g for g in go if g[2] < 0]
        places, nodes, docs = (np.array([g[i] for g in near], np.int64) for i in range(3))
        if spans:
            mask = np.zeros(len(self.starts) + 1, np.int64)
            for a, to, _ in spans:
                mask[np.searchsorted(self.starts, a)] += 1
                mask[to] -= 1
            later = np.flatnonzero(np.cumsum(mask[:-1]) > 0)
            places = np.concatenate([places, self.starts[later]])
            nodes = np.concatenate([nodes, self.roots[later]])
            docs = np.concatenate([docs, self.doc[later]])
        self.walk(path, places, nodes, docs, edges)
        return edges, gumbel

    def ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of a path, and offsets by document."""
        place = np.flatnonzero(edges >= 0)
        return (self.lattice.piece[edges[place]] if len(place) else np.zeros(0, np.int64)), np.searchsorted(place, self.offsets)


def decode(vocabulary: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts that ids stand for, without the space in front."""
    length = vocabulary.at[ids + 1] - vocabulary.at[ids]
    to = np.concatenate([[0], np.cumsum(length)])
    out = vocabulary.bytes[np.repeat(vocabulary.at[ids] - to[:-1], length) + np.arange(to[-1])]
    ends = to[offsets]
    front = ends[:-1][np.diff(ends) > 0]
    return np.delete(out, front), ends - np.searchsorted(front, ends)


def sample_segmentations(docs: DataFrame, model_file: str, k: int = 2, seed: int = 0, with_ids: bool = True) -> DataFrame:
    """doc_id, n_bytes, paths for every row of docs(doc_id, text).

    paths is an array of struct(n_tokens, ids_crc32, log_prob, gumbel,
    log_inclusion, decodes, ids), best noise first; ids_crc32 is over the ids as
    little-endian unsigned 32-bit integers, decodes tells whether decoding gives
    the text back, and ids is null unless with_ids. A text with fewer than k
    segmentations has them all, the last with log_inclusion 0; null and empty
    texts have none. Random numbers depend on seed, doc_id and position, so rows
    that repeat a doc_id and text get equal paths; a null doc_id has a key of
    its own. Other columns are ignored. An empty table gives no rows.
    """
    fields = pa.struct(
        [("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("log_prob", pa.float64()), ("gumbel", pa.float64()),
         ("log_inclusion", pa.float64()), ("decodes", pa.bool_()), ("ids", pa.list_(pa.int32()))]
    )

    def run(batches):
        vocabulary = Vocabulary.of_worker(model_file)
        for batch in blocks(batches, limit=BLOCK):
            data, offsets = utf8(batch.column("text"))
            keys = batch.column("doc_id")
            seeds = mix(mix(np.asarray(keys.fill_null(-(1 << 62))).astype(np.int64).view(np.uint64)) + np.uint64(seed))
            sampler = Sampler(vocabulary, data, offsets, seeds, vocabulary.lattice)
            paths, kappa = sampler.sample(k)
            columns: list[list] = [[] for _ in range(7)]
            there = []
            for edges, log_p, gumbel in paths:
                ids, to = sampler.ids(edges)
                ids = ids.astype(np.uint32)
                back, back_to = decode(vocabulary, ids, to)
                raw = ids.astype("<u4").tobytes()
                same = np.array_equal(back, data) and np.array_equal(back_to, offsets)
                ok = np.full(len(log_p), same)
                if not same:
                    ok = np.array([np.array_equal(back[back_to[d] : back_to[d + 1]], data[offsets[d] : offsets[d + 1]]) for d in range(len(ok))])
                there.append(gumbel > -np.inf)
                with np.errstate(over="ignore", divide="ignore"):
                    sure = log_p - kappa
                    inclusion = np.where(sure < -30, sure, np.log(-np.expm1(-np.exp(np.minimum(sure, 50.0)))))
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(to[:-1], to[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(ids.astype(np.int32))) if with_ids else pa.nulls(len(crc), pa.list_(pa.int32()))
                for c, v in zip(columns, (np.diff(to), crc, log_p, gumbel, inclusion, ok, lists), strict=True):
                    c.append(v if isinstance(v, pa.Array) else pa.array(v))
            rows = batch.num_rows
            order = np.arange(rows * len(paths)).reshape(len(paths), rows).T
            there = np.stack(there, axis=1)
            flat = order[there]
            arrays = [pa.concat_arrays(c).cast(t.type).take(pa.array(flat)) for c, t in zip(columns, fields, strict=True)]
            count = np.concatenate([[0], np.cumsum(there.sum(axis=1))])
            nested = pa.ListArray.from_arrays(pa.array(count, pa.int32()), pa.StructArray.from_arrays(arrays, fields=list(fields)))
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.diff(offsets)), nested], ["doc_id", "n_bytes", "paths"])

    schema = (
        "doc_id long, n_bytes long, paths array<struct<n_tokens:long,ids_crc32:long,log_prob:double,gumbel:double,"
        "log_inclusion:double,decodes:boolean,ids:array<int>>>"
    )
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids: the library's own segmentation of each text; null texts count as empty."""

    def run(batches):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for batch in blocks(batches):
            ids = sp.encode([t or "" for t in batch.column("text").to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, model_file: str) -> DataFrame:
    """doc_id, text from rows (doc_id, ids); null ids count as empty."""

    def run(batches):
        vocabulary = Vocabulary.of_worker(model_file)
        for batch in batches:
            lists = batch.column("ids").fill_null([]) if batch.column("ids").null_count else batch.column("ids")
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py() if len(lists) else np.zeros(1, int)
            text, to = decode(vocabulary, ids, offsets)
            raw = text.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(to[:-1], to[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(sampled: DataFrame) -> DataFrame:
    """A row per document: counts and checks of its paths without their ids."""
    return sampled.select(
        "doc_id", "n_bytes", F.size("paths").cast("long").alias("n_paths"),
        F.transform("paths", lambda p: p["n_tokens"]).alias("n_tokens"),
        F.transform("paths", lambda p: p["ids_crc32"]).alias("ids_crc32"),
        F.transform("paths", lambda p: F.round(p["log_prob"], 6)).alias("log_prob"),
        F.transform("paths", lambda p: F.round(p["log_inclusion"], 6)).alias("log_inclusion"),
        F.forall("paths", lambda p: p["decodes"]).alias("decodes"),
    )
