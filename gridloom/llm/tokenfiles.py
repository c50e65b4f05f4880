"""Token-id files: independent zstandard frames, a document index and a seek table.

File := frame+ index_frame seek_table. Each frame holds the ids of some whole
documents, little-endian, with zstandard's own content checksum. The index is a
skippable frame that says which frame and place each document has. The seek
table is the skippable frame of the public seekable format, with a checksum of
each frame's content. A reader fetches the tail of the file, then only the
frames of the documents that it wants.

Writers get documents range-partitioned and sorted by doc_id. A file is written
under a name of its own and renamed when whole, so a task that runs again, or
twice, leaves the same file.
"""

from __future__ import annotations

import itertools
import os
import string
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import materialize, scratch_path
from .textcore import blocks, byte_set, span_hashes, utf8

SKIPPABLE, SEEK_TABLE, SEEK_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 1 << 17
#: Pieces that an encoder remembers before it begins anew, slots of its table of them, pieces encoded in one string, and ids for which room is made at least.
CACHE_WORDS, SLOTS, JOINED, LEARNED = 1 << 20, 1 << 21, 1000, 1 << 15
#: Encoders of this worker by tokenizer file and setting.
_HELD: dict[tuple[str, bool], ChunkEncoder] = {}


def blank_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each byte begins, and whether it ends, a character that is white space (or a separator control)."""
    begins = byte_set(b"\t\n\v\f\r\x1c\x1d\x1e\x1f ")[data]
    ends = begins.copy()
    at = np.flatnonzero(data[:-1] == 0xC2)
    at = at[(data[at + 1] == 0xA0) | (data[at + 1] == 0x85)]
    begins[at], ends[at + 1] = True, True
    at = np.flatnonzero((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3)) if len(data) > 2 else np.zeros(0, int)
    char = (data[at].astype(np.int64) << 16) | (data[at + 1].astype(np.int64) << 8) | data[at + 2]
    wide = np.isin(char, [*range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080, 0xE19A80])
    begins[at[wide]], ends[at[wide] + 2] = True, True
    return begins, ends


class ChunkEncoder:
    """Encodes texts by pieces of words, a block at a time, remembering pieces.

    Byte-level BPE with a leading-space pattern never joins a visible character
    to a following space, so a text may be cut before each single space that has
    visible characters on both sides. Where its pattern also keeps line ends and
    stops apart from words, it is cut in the same way before single line ends,
    and between a letter or digit and a stop. Pieces are known by 64-bit hashes
    (two different ones are taken for one with a chance of 2**-64) and found by
    them in a table of slots, where a later piece displaces an earlier one.
    Unknown pieces that begin with a space or line end and end visibly are encoded
    many in one string, as they don't join, and told apart by the bytes that ids
    stand for.
    """

    #: Bytes of letters and digits, and stops; letters of two bytes are those of Latin-1, with this first byte but for two signs.
    WORD, STOPS = string.ascii_letters + string.digits, "!\"#$%&'()*+,-./:;=?@[]^_`{}~"
    LATIN, SIGNS = 0xC3, byte_set(b"\x97\xb7")

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        names = tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(names.values()) + 1, np.int64)
        for name, k in names.items():
            self.bytes_of[k] = len(name)  # a letter of a byte-level name is a byte
        whole = set()
        for k, added in tokenizer.get_added_tokens_decoder().items():
            self.bytes_of[k] = len(added.content.encode())
            whole |= set(added.content)
        shown = "".join(f"a{c}b1{c}\n\u00e9{c}" for c in self.STOPS)
        pieces = [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(shown)] if tokenizer.pre_tokenizer else []
        apart = pieces == [p for c in self.STOPS for p in ("a", c, "b", "1", c, "\u010a", "\u00c3\u00a9", c)]
        kept = lambda chars: byte_set("".join(c for c in chars if c not in whole).encode())
        self.breaks, self.stops = kept(" \n" if apart else " "), kept(self.STOPS if apart else "")
        self.word = byte_set(self.WORD.encode())
        self.clear()

    @classmethod
    def of_worker(cls, tokenizer_file: str, special_as_text: bool = False) -> ChunkEncoder:
        """One encoder for the life of a Python worker, so tasks find what earlier ones remembered."""
        key = (tokenizer_file, special_as_text)
        if key not in _HELD:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
            import tokenizers

            tokenizer = tokenizers.Tokenizer.from_file(tokenizer_file)
            tokenizer.encode_special_tokens = special_as_text
            _HELD[key] = cls(tokenizer)
        return _HELD[key]

    def clear(self):
        """Remembers nothing: no hashes in slots, each with the place of its ids (begin in the upper half, size in the lower)."""
        self.known, self.place = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int64)
        self.ids, self.held, self.count = np.zeros(0, np.uint32), 0, 0

    def _learn(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Takes in distinct pieces with their ids; returns the places of these."""
        if self.held + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.held], np.zeros(len(ids) + max(self.held, LEARNED), np.uint32)])
        self.ids[self.held : self.held + len(ids)] = ids
        places = ((self.held + np.cumsum(sizes) - sizes) << 32) | sizes
        slots = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        self.known[slots] = hashes
        first = np.flatnonzero(self.known[slots] == hashes)  # of two in one slot the one that is there
        self.place[slots[first]] = places[first]
        self.held, self.count = self.held + len(ids), self.count + len(hashes)
        return places

    def _unknown(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, joins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, and how many each has: those that join nothing are encoded many in one string."""
        some, rest = np.flatnonzero(~joins), np.flatnonzero(joins)
        raw, to = spread_spans(data, starts[some], (ends - starts)[some])
        raw, upto = raw.tobytes(), np.append(to[:-1:JOINED], to[-1]).tolist()
        strings = [raw[a:b].decode() for a, b in itertools.pairwise(upto)]
        pool = np.concatenate([np.zeros(0, np.uint32), *[np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]])
        upto, stops = np.cumsum(self.bytes_of[pool]), to[1:]
        last = np.searchsorted(upto, stops)
        if len(some) and (upto[-1] != stops[-1] or (upto[last] != stops).any()):
            raise ValueError("ids don't add up to the bytes of their text: a byte-level tokenizer is needed")
        texts = [data[a:b].tobytes().decode() for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
        alone = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.zeros(len(starts), np.int64)
        sizes[some], sizes[rest] = np.diff(last + 1, prepend=0), [len(x) for x in alone]
        begin = np.zeros(len(starts), np.int64)
        begin[some], begin[rest] = last + 1 - sizes[some], len(pool) + np.cumsum(sizes[rest]) - sizes[rest]
        return spread_spans(np.concatenate([pool, *alone]), begin, sizes)[0], sizes

    def encode(self, texts, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (a list or a string column), end appended to each, and their offsets."""
        data, offsets = utf8(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        n, docs = len(data), len(offsets) - 1
        if not n:
            return np.full(docs, end, np.uint32), np.arange(docs + 1)
        begins, finishes = blank_edges(data)
        cut = np.zeros(n, bool)
        at = np.flatnonzero(self.breaks[data[1:-1]]) + 1
        cut[at[~finishes[at - 1] & ~begins[at + 1]]] = True
        edges = offsets[(offsets > 0) & (offsets < n)]
        cut[edges], cut[edges - 1] = False, False  # the spaces at a text's ends
        heads = np.unique(offsets[:-1][np.diff(offsets) > 0])
        plain = cut.copy()
        cut[heads] = True
        at = np.flatnonzero(self.stops[data[1:]]) + 1
        behind = data[at - 1]
        latin = (behind >= 0x80) & (data[at - 2] == self.LATIN) & ~self.SIGNS[behind]
        cut[at[self.word[behind] | latin]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        hashes = span_hashes(data, starts, ends)
        slots = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        place = self.place[slots]
        new = np.flatnonzero(self.known[slots] != hashes)
        fresh, shown, which = np.unique(hashes[new], return_index=True, return_inverse=True)
        a, b = starts[new[shown]], ends[new[shown]]
        place[new] = self._learn(fresh, *self._unknown(data, a, b, ~plain[a] | finishes[b - 1]))[which]
        flat, to = spread_spans(self.ids, place >> 32, place & 0xFFFFFFFF)
        if self.count > CACHE_WORDS:
            self.clear()
        stops = to[np.searchsorted(starts, offsets[1:])]
        return np.insert(flat, stops, np.uint32(end)), np.concatenate([[0], stops + np.arange(1, docs + 1)])


def spread_spans(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans of pool one after the other, and their offsets."""
    to = np.concatenate([[0], np.cumsum(size)])
    return pool[np.repeat(begin - to[:-1], size) + np.arange(to[-1])], to


class FrameWriter:
    """Writes documents' ids to one file object."""

    def __init__(self, out, dtype=np.uint16):
        self.out, self.dtype = out, np.dtype(dtype).newbyteorder("<")
        self.zip = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.waiting, self.size = [], 0
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int | None, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype(self.dtype).tobytes()
        self.docs.append((doc_id, len(self.frames), len(ids)))
        self.waiting.append(raw)
        self.size += len(raw)
        if self.size >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            raw = b"".join(self.waiting)
            packed = self.zip.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64(raw).intdigest() & 0xFFFFFFFF))
            self.waiting, self.size = [], 0

    def close(self) -> None:
        self.flush()
        ids = np.array([d or 0 for d, _, _ in self.docs], "<i8").tobytes()
        null = np.array([d is None for d, _, _ in self.docs], "u1").tobytes()
        frame = np.array([f for _, f, _ in self.docs], "<u4").tobytes()
        length = np.array([n for _, _, n in self.docs], "<u4").tobytes()
        index = self.zip.compress(struct.pack("<IB", len(self.docs), self.dtype.itemsize) + ids + null + frame + length)
        self.out.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
        self.frames.append((8 + len(index), 0, xxhash.xxh64(b"").intdigest() & 0xFFFFFFFF))
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 1 << 7, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SEEK_TABLE, len(table)) + table)


class FrameReader:
    """Reads documents' ids from a random-access file."""

    def __init__(self, file, size: int):
        self.file = file
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or flags != 1 << 7:
            raise ValueError("no seek table with checksums")
        table = self._at(size - 9 - 12 * frames, 12 * frames)
        self.table = np.frombuffer(table, "<u4").reshape(frames, 3).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        head = self._at(self.offsets[-2], 8)
        if struct.unpack("<II", head) != (SKIPPABLE, self.table[-1, 0] - 8):
            raise ValueError("no document index")
        self.unzip = zstandard.ZstdDecompressor()
        index = self.unzip.decompress(self._at(self.offsets[-2] + 8, self.table[-1, 0] - 8))
        n, width = struct.unpack_from("<IB", index)
        self.dtype = f"<u{width}"
        self.ids = np.frombuffer(index, "<i8", n, 5)
        self.null = np.frombuffer(index, "u1", n, 5 + 8 * n).astype(bool)
        self.frame = np.frombuffer(index, "<u4", n, 5 + 9 * n)
        self.length = np.frombuffer(index, "<u4", n, 5 + 13 * n)

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(int(offset))
        return self.file.read(int(size))

    def read_frame(self, k: int) -> np.ndarray:
        raw = self.unzip.decompress(self._at(self.offsets[k], self.table[k, 0]))
        if xxhash.xxh64(raw).intdigest() & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return np.frombuffer(raw, self.dtype)

    def read(self, place: int) -> np.ndarray:
        """Ids of the document at that place of the index."""
        k = int(self.frame[place])
        before = int(self.length[np.searchsorted(self.frame, k) : place].sum())
        return self.read_frame(k)[before : before + int(self.length[place])]

    def scan(self):
        """(doc_id or None, ids) of all documents in order, a frame in memory at a time."""
        held, now, at = -1, None, 0
        for k in range(len(self.ids)):
            if self.frame[k] != held:
                held, at = int(self.frame[k]), 0
                now = self.read_frame(held)
            yield (None if self.null[k] else int(self.ids[k])), now[at : at + int(self.length[k])]
            at += int(self.length[k])


def write_token_files(docs: DataFrame, tokenizer_file: str, folder: str, end: int = 0, special_as_text: bool = False) -> DataFrame:
    """shard, path, n_docs, n_ids, a row per file of folder (a URI), from docs(doc_id, text).

    Files and their documents ascend by doc_id, nulls first, then by a hash of
    the text. Null texts count as empty and have just the end id. Repeated rows
    are written each. An empty table gives no file. Other columns are ignored.
    A special token's string in a text is that token, as is the library's
    default, unless special_as_text.
    """

    def run(batches):
        encoder = ChunkEncoder.of_worker(tokenizer_file, special_as_text)
        dtype = np.uint16 if encoder.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        shard = TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(folder)
        name, own = f"{root}/part-{shard:06d}.tok", f"{root}/_{shard:06d}-{uuid.uuid4().hex}"
        writer, total = None, 0
        for batch in blocks(batches):
            if writer is None:
                fs.create_dir(root)
                out = fs.open_output_stream(own)
                writer = FrameWriter(out, dtype)
            ids, to = encoder.encode(batch.column("text"), end)
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                writer.add(doc_id, ids[to[k] : to[k + 1]])
            total += len(ids)
        if writer is not None:
            writer.close()
            out.close()
            fs.move(own, name)
            row = [[shard], [name], [len(writer.docs)], [total]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in row], ["shard", "path", "n_docs", "n_ids"])

    ranged = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange("doc_id", "tie")
    ranged = ranged.sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return materialize(ranged.mapInArrow(run, "shard long, path string, n_docs long, n_ids long"), "token-files")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, from what is in the files.

    A row per document written, repeated and null ids too; no files give no rows.
    """

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_file(path) as file:
                    reader = FrameReader(file, file.size())
                    scan = reader.scan()
                    while part := list(itertools.islice(scan, 4096)):
                        n = np.array([len(ids) for _, ids in part], np.int64)
                        begin = start + np.cumsum(n) - n
                        start += int(n.sum())
                        crc = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in part]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([d for d, _ in part], pa.int64()), pa.array(begin), pa.array(n), pa.array(crc, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    before = F.coalesce(F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = files.select("shard", "path", before.alias("start")).repartition("shard")
    return placed.select("path", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_file: str, end: int = 0, **options) -> DataFrame:
    """Write docs to a new folder in the shared one, and read the files back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, tokenizer_file, folder, end, **options), folder)
