"""Vectorised word hashing over Arrow string columns.

Words are maximal runs of bytes that are no separators, found and hashed for a
whole block of documents at once. A word's hash is a polynomial over random
64-bit values of its bytes modulo 2**64, finished by a mixing step; equal words
have equal hashes, and two different ones collide with a chance near 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BLOCK_BYTES = 1 << 19
#: Powers of a hash's base that a worker holds, by base, and the greatest exponent of them.
_POWERS: dict[int, np.ndarray] = {}
HELD_POWERS = 1 << 20


def give_back() -> None:
    """Return freed memory to the system; Python workers outlive their tasks, and executors share one limit."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has at most limit bytes in column, or one row; memory is given back after the last."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    kind = pa.large_binary()
    column = pc.fill_null(column.cast(kind), pa.scalar(b"", kind))
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a block: starts, ends (byte positions), hashes, and first: the number of the first word of each document, and of all words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: bytes = b" \t\n\v\f\r", lower: bool = False):
        if lower:
            fold = np.arange(256, dtype=np.uint8)
            fold[65:91] += 32
            data = fold[data]
        self.data = data
        n = len(data)
        solid = ~byte_set(separators)[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        before[inner], after[inner - 1] = False, False
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.solid = solid

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**n modulo 2**64; those that blocks need are held, longer rows have their own."""
    held = _POWERS.get(base, np.ones(1, np.uint64))
    if len(held) <= n:
        held = np.full(n + 1, base, np.uint64)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        if n <= HELD_POWERS:
            _POWERS[base] = held
    return held[: n + 1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(data)
    values = mix(np.arange(1, 257, dtype=np.uint64) << np.uint64(32))
    base = 0x2545F4914F6CDD1D
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * powers(base, n)[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(pow(base, -1, 1 << 64), n)[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on, for places that have n words; documents are not minded."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:count].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + count])
    return out


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document; its whole sequence if it has fewer words than n; empty without words."""
    h = words.hashes()
    grams = gram_hashes(h, n)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(gram_hashes(h[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores put before it as make it new to df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def add_column(docs: DataFrame, name: str, kind: str, measure: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """All columns of docs, and a new one that measure makes of blocks of rows."""

    def run(batches):
        for batch in blocks(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, measure(batch)], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T._parse_datatype_string(kind))]))


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    """Rows of a binary column of equal lengths, as a matrix."""
    data, _ = utf8(column)
    return data.view(dtype).reshape(len(column), width)
