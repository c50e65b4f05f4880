"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A piece of n tokens is of class k = capacity // n: k pieces of it fill a
sequence. Every worker fills the sequences of each class on its own, k pieces
in each, and needs no knowledge of other workers. A document is cut into
sequences of its own, and a rest that is cut only where its class would waste
more than a share of the capacity: then the largest reciprocal part of the
capacity comes off, which leaves (almost) nothing free in its class, and what
remains is judged anew. Small rests waste little in any class.

What a worker leaves open is less than one sequence a class, so its size does
not depend on the input. Open sequences of FAN workers meet in one task and
are filled by the same rule, in rounds until one task has the last. There
the rest is joined without regard to classes, cut at the capacity, and at the
end into powers of two, which need no padding.
"""

from __future__ import annotations

import itertools
import os
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import materialize
from .textcore import Words, blocks, byte_set, span_hashes, utf8
from .tokenfiles import JOINED, spread_spans

#: Workers whose open sequences meet in a task; share of the capacity that a class may leave free; sequences a batch.
FAN, WASTE, BATCH = 64, 1 / 64, 256
BLOCK = 1 << 20
#: Bytes a core of stored documents, below which rows are dealt to all cores first.
SMALL = 4 << 20
#: Encoders of this worker by tokenizer file.
_HELD: dict[str, WordEncoder] = {}


class WordEncoder:
    """Encodes texts word by word, and remembers words by 64-bit hashes.

    For tokenizers that drop white space and join nothing over it, nor a letter
    or digit and a following stop. Words of letters that the tokenizer shapes
    one by one go to its model at once; others are encoded many in one string,
    with a control character between them that has an id of its own, or alone
    where they hold this character.
    """

    MARK, ROOM = "\x01", 1_500_000
    LETTERS, STOPS = byte_set(string.ascii_letters.encode() + string.digits.encode()), byte_set(b",.;:!?")

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        plain = lambda s: tokenizer.encode(s, add_special_tokens=False).ids
        if len(plain(self.MARK)) != 1 or plain(f"ab {self.MARK}\nc") != plain("ab") + plain(self.MARK) + plain("c"):
            raise ValueError("a tokenizer that drops white space is needed")
        self.mark = plain(self.MARK)[0]
        letters = string.ascii_letters + "".join(map(chr, range(0xC0, 0x100)))
        pieces = lambda s: [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(s))]
        shapes = {c: p[0] for c in letters if c.isalpha() and len(p := pieces(c)) == 1}
        if pieces("".join(shapes)) != ["".join(shapes.values())]:
            shapes = {}
        self.shape, self.letters = str.maketrans(shapes), re.compile(f"[{''.join(shapes)}]+" if shapes else "(?!)")
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.begin, self.size, self.ids, self.held = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32), 0

    @classmethod
    def of_worker(cls, tokenizer_file: str) -> WordEncoder:
        """One encoder for the life of a Python worker, so tasks find what earlier ones remembered."""
        if tokenizer_file not in _HELD:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
            import tokenizers

            _HELD[tokenizer_file] = cls(tokenizers.Tokenizer.from_file(tokenizer_file))
        return _HELD[tokenizer_file]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and how many each has: of letters alone by the model, others by the whole tokenizer."""
        words = [data[a:b].decode(errors="replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        kind = np.array([0 if self.letters.fullmatch(w) else 1 + (self.MARK in w) for w in words], np.int8)
        easy, some, odd = (np.flatnonzero(kind == k) for k in range(3))
        tokenize, shape = self.tokenizer.model.tokenize, self.shape
        given = [[t.id for t in tokenize(words[i].translate(shape))] for i in easy.tolist()]
        between = f" {self.MARK} "
        joined = self._ids([between.join([*(words[i] for i in some[a : a + JOINED]), ""]) for a in range(0, len(some), JOINED)])
        alone = self._ids([words[i] for i in odd.tolist()])
        first = np.fromiter(itertools.chain.from_iterable(given), np.uint32)
        pool = np.concatenate([first, *joined])
        stops = np.flatnonzero(pool[len(first) :] == self.mark) + len(first)
        if len(stops) != len(some):
            raise ValueError("words and their ids don't match")
        begin, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        sizes[easy], sizes[odd] = [len(x) for x in given], [len(x) for x in alone]
        begin[easy] = np.cumsum(sizes[easy]) - sizes[easy]
        begin[some] = np.concatenate([[len(first)], stops[:-1] + 1]) if len(some) else 0
        sizes[some] = stops - begin[some]
        begin[odd] = len(pool) + np.cumsum(sizes[odd]) - sizes[odd]
        return spread_spans(np.concatenate([pool, *alone]), begin, sizes)[0], sizes

    def _remember(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Takes in words that it doesn't know, in the order of their hashes."""
        place = np.searchsorted(self.known, hashes)
        self.begin = np.insert(self.begin, place, self.held + np.cumsum(sizes) - sizes)
        self.known, self.size = np.insert(self.known, place, hashes), np.insert(self.size, place, sizes)
        if self.held + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.held], np.zeros(self.held + 2 * len(ids), np.uint32)])
        self.ids[self.held : self.held + len(ids)] = ids
        self.held += len(ids)

    def encode(self, texts, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (a list or a string column), end appended to each, and their offsets."""
        data, offsets = utf8(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        docs, words = len(offsets) - 1, Words(data, offsets)
        if not len(words.starts):
            return np.full(docs, end, np.uint32), np.arange(docs + 1)
        stop = np.flatnonzero(self.STOPS[data[1:]] & self.LETTERS[data[:-1]]) + 1
        stop = np.setdiff1d(stop, offsets, assume_unique=False)
        starts, ends = np.sort(np.concatenate([words.starts, stop])), np.sort(np.concatenate([words.ends, stop]))
        hashes, shown, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > self.ROOM:
            self.clear()
        place = np.searchsorted(self.known, hashes)
        inside = np.flatnonzero(place < len(self.known))
        hit = np.zeros(len(hashes), bool)
        hit[inside] = self.known[place[inside]] == hashes[inside]
        new = np.flatnonzero(~hit)
        if len(new):
            self._remember(hashes[new], *self._new(data.tobytes(), starts[shown[new]], ends[shown[new]]))
        place = np.searchsorted(self.known, hashes)
        flat, to = spread_spans(self.ids, self.begin[place][which], self.size[place][which])
        stops = to[np.searchsorted(starts, offsets[1:])]
        return np.insert(flat, stops, np.uint32(end)), np.concatenate([[0], stops + np.arange(1, docs + 1)])


def rest_cuts(capacity: int, waste: float = WASTE) -> list[list[int]]:
    """For each rest below the capacity, the lengths that it is cut into, largest first."""
    out: list[list[int]] = [[]]
    for rest in range(1, capacity):
        k = capacity // rest
        part = rest if capacity - k * rest <= waste * capacity else capacity // (k + 1)
        out.append([part, *out[rest - part]])
    return out


class Bins:
    """The open sequences of one worker, by class; full ones are handed out with their numbers."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.open: dict[int, list] = {}

    def add(self, ids: np.ndarray, doc_id, start: int, doc_tokens: int) -> list | None:
        """Puts in a piece; the pieces of the sequence if it is full now."""
        k = self.capacity // len(ids)
        held = self.open.setdefault(k, [])
        held.append((ids, doc_id, start, doc_tokens))
        return self.open.pop(k) if len(held) == k else None

    def number(self) -> int:
        self.next += 1
        return self.next - 1

    def rest(self) -> Iterator[list]:
        """What is open, joined: sequences of the whole capacity, then of falling powers of two."""
        left = [p for k in sorted(self.open) for p in self.open[k]][::-1]
        total = sum(len(p[0]) for p in left)
        while total:
            size = self.capacity if total >= self.capacity else 1 << (total.bit_length() - 1)
            total -= size
            held = []
            while size:
                ids, doc_id, start, doc_tokens = left.pop()
                held.append((ids[:size], doc_id, start, doc_tokens))
                if len(ids) > size:
                    left.append((ids[size:], doc_id, start + size, doc_tokens))
                size -= len(held[-1][0])
            yield held


def _sequence_type(id_type: T.DataType) -> T.StructType:
    piece = T.StructType([T.StructField("doc_id", id_type), *[T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens", "offset")]])
    return T.StructType(
        [
            T.StructField("sequence_id", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("padded", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("pieces", T.ArrayType(piece)),
            T.StructField("worker", T.LongType()),
        ]
    )


def _table(rows: list[tuple[int | None, list]], capacity: int, worker: int, schema: pa.Schema) -> pa.RecordBatch:
    """Rows of (sequence number or None if it is open, pieces)."""
    out = []
    for number, pieces in rows:
        total, told = 0, []
        for ids, doc_id, start, doc_tokens in pieces:
            told.append({"doc_id": doc_id, "start": start, "length": len(ids), "doc_tokens": doc_tokens, "offset": total})
            total += len(ids)
        whole = total if total & (total - 1) == 0 else capacity
        ids = np.concatenate([p[0] for p in pieces]).astype("<u4").tobytes()
        out.append({"sequence_id": number, "n_tokens": total, "padded": whole, "ids": ids, "pieces": told, "worker": worker})
    return pa.RecordBatch.from_pylist(out, schema)


def _batches(full: Iterator[tuple[int | None, list]], capacity: int, worker: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while rows := list(itertools.islice(full, BATCH)):
        yield _table(rows, capacity, worker, schema)


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of a small table dealt to all cores, as its file may be one split."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * SMALL else rows


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end: int = 2, fan: int = FAN) -> DataFrame:
    """sequence_id, n_tokens, padded, ids, pieces: a row per sequence, from docs(doc_id, text).

    ids are the tokens, little-endian and four bytes each, of the pieces
    (doc_id, start in its document, length, doc_tokens of its document, offset
    here) one after the other; each id of a document, the end id included, is
    in one piece. padded is the length that a sequence is padded to: the
    capacity, or its own if that is a power of two. Ids of sequences are unique,
    not consecutive.

    A null text counts as empty and has just the end id. Null and repeated
    doc_ids, and repeated rows, are documents of their own. A special token's
    string in a text is that token, as is the library's default. Other columns
    are ignored. An empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if capacity < 2:
        raise ValueError("a sequence needs room for two tokens")
    cuts = rest_cuts(capacity)
    kind = _sequence_type(docs.schema["doc_id"].dataType)
    schema = to_arrow_schema(kind)

    def fill(batches):
        encoder, worker = WordEncoder.of_worker(tokenizer_file), TaskContext.get().partitionId()
        bins = Bins(capacity, worker << 32)

        def full():
            for batch in blocks(batches, limit=BLOCK):
                flat, to = encoder.encode(batch.column("text"), end)
                for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                    at, stop = int(to[k]), int(to[k + 1])
                    n, start = stop - at, 0
                    for length in itertools.chain(itertools.repeat(capacity, n // capacity), cuts[n % capacity]):
                        # a copy, as an open sequence would hold the whole block
                        if done := bins.add(flat[at + start : at + start + length].copy(), doc_id, start, n):
                            yield bins.number(), done
                        start += length
            yield from ((None, pieces) for pieces in bins.open.values())

        yield from _batches(full(), capacity, worker, schema)

    def refill(level: int, last: bool):
        def run(key, rows):
            worker = key[0].as_py()
            bins = Bins(capacity, level << 56 | worker << 32)
            rows = rows.sort_by([("worker", "ascending"), ("n_tokens", "ascending"), ("ids", "ascending")])

            def full():
                for ids, pieces in zip(rows.column("ids"), rows.column("pieces"), strict=True):
                    flat = np.frombuffer(ids.as_buffer(), "<u4")
                    for p in pieces.as_py():
                        if done := bins.add(flat[p["offset"] : p["offset"] + p["length"]], p["doc_id"], p["start"], p["doc_tokens"]):
                            yield bins.number(), done
                if last:
                    yield from ((bins.number(), pieces) for pieces in bins.rest())
                else:
                    yield from ((None, pieces) for pieces in bins.open.values())

            return pa.Table.from_batches(_batches(full(), capacity, worker, schema), schema)

        return run

    done, level = [materialize(_dealt(docs.select("doc_id", F.col("text").cast("string").alias("text"))).mapInArrow(fill, kind), "packed")], 0
    workers = (done[0].agg(F.max("worker")).first()[0] or 0) + 1
    while level == 0 or workers > 1:
        workers, level = -(-workers // fan), level + 1
        left = done[-1].where("sequence_id is null").withColumn("_group", F.floor(F.col("worker") / fan).cast("long"))
        done.append(materialize(left.groupBy("_group").applyInArrow(refill(level, workers == 1), kind), "packed"))
    out = done[0].where("sequence_id is not null")
    for more in done[1:]:
        out = out.union(more.where("sequence_id is not null"))
    return out.drop("worker")


def piece_digests(packed: DataFrame) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row per piece of pack_documents(), read from its ids."""
    told = F.transform(
        "pieces",
        lambda p: F.struct(
            p["doc_id"].alias("doc_id"),
            p["start"].alias("start"),
            p["length"].alias("length"),
            F.crc32(F.substring(F.col("ids"), (4 * p["offset"] + 1).cast("int"), (4 * p["length"]).cast("int"))).alias("ids_crc32"),
            p["doc_tokens"].alias("doc_tokens"),
            F.col("sequence_id").alias("sequence_id"),
            p["offset"].alias("offset"),
        ),
    )
    return packed.select(F.inline(told))
