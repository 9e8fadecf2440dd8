"""Packing documents into sequences of a fixed length by bounded-space online best fit.

Each input partition keeps at most `windows` open windows. A document is its token ids and a closing id; what exceeds a
sequence is cut off as full sequences first. The remainder goes to the open window that it fills best. When none has room,
the fullest is emitted; if its gap is worth a cut, the head of the remainder fills it. At the end of a partition the open
windows, at most `windows` of them whatever the partition's size, go on with their ids to a merge over groups of
partitions: their pieces fill windows one after another, and what is left over is cut at powers of two, which need no padding.

The online step is deterministic for a partition, so a rerun after a lost executor gives the same rows. Its result is
written once to the shared folder; only leftovers (ids included) are shuffled, never the corpus.

Defined cases: null and empty text is a document of the closing id alone; a text of any length is cut as above; repeated
rows and rows with equal or null ids are packed each on their own; ids keep their type and value; of equally full windows the
one opened first is taken; an empty table gives no rows; the columns of the input other than id and text are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_types, materialise, record_batch, slices, text_or_empty, tokenizer_path
from .tokencount import byte_symbols
from .wordsplit import Splitter

SEQUENCE, END_ID, WINDOWS = 2048, 1, 64
#: A gap under this many tokens is left as padding rather than filled by cutting a piece.
LEAST_CUT = 8
#: So many partitions' leftovers are merged together.
MERGED_PARTITIONS = 16
KEPT_WORDS, KEPT_LENGTH = 500_000, 64

PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds(dict):
    """word -> its ids as little-endian 32-bit bytes, by the library's model on the word's byte symbols; short words are kept."""

    def __init__(self, tokenizer):
        self.model, self.symbols = tokenizer.model, byte_symbols()

    def __missing__(self, word: str) -> bytes:
        ids = to_bytes([t.id for t in self.model.tokenize("".join(map(self.symbols.__getitem__, word.encode("utf-8"))))])
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids


def to_bytes(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


@lru_cache(maxsize=4)
def _tools(path: str) -> tuple[Splitter, WordIds]:
    split = Splitter(path)
    return split, WordIds(split.tokenizer)


def document_ids(text: str | None, path: str, end_id: int = END_ID) -> bytes:
    """All ids of a document with the closing id, four bytes each."""
    split, ids = _tools(path)
    parts = []
    for special, piece in split.segments(text or ""):
        if special:
            parts.append(to_bytes([split.tokenizer.token_to_id(piece)]))
        else:
            parts.extend(map(ids.__getitem__, split.words(piece)))
    parts.append(to_bytes([end_id]))
    return b"".join(parts)


class Window:
    """Pieces of one open sequence: (doc, start, ids, doc_tokens)."""

    __slots__ = ("pieces", "used")

    def __init__(self):
        self.pieces, self.used = [], 0

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        self.pieces.append((doc, start, ids, total))
        self.used += len(ids) // 4


class Packer:
    """The online step for one partition. `emit` gets each finished window."""

    def __init__(self, emit, size: int = SEQUENCE, windows: int = WINDOWS, least_cut: int = LEAST_CUT):
        self.emit, self.size, self.most, self.least_cut = emit, size, windows, least_cut
        self.open: list[tuple[int, int, Window]] = []  # (gap, order, window), sorted
        self.order = 0

    def put(self, doc, ids: bytes) -> None:
        total, start, size = len(ids) // 4, 0, self.size
        while total - start >= size:
            w = Window()
            w.add(doc, start, ids[4 * start : 4 * (start + size)], total)
            self.emit(w)
            start += size
        while start < total:
            left = total - start
            at = bisect_left(self.open, (left, -1))
            if at < len(self.open):  # best fit: the smallest gap that holds it
                start = self._fill(at, doc, start, left, ids, total)
            elif len(self.open) < self.most:
                self.order += 1
                self.open.append((size, self.order, Window()))  # the largest gap: stays sorted
            elif self.open[0][0] >= self.least_cut:  # the fullest, its gap worth a cut
                start = self._fill(0, doc, start, self.open[0][0], ids, total)
            else:
                self.emit(self.open.pop(0)[2])

    def _fill(self, at: int, doc, start: int, n: int, ids: bytes, total: int) -> int:
        gap, order, w = self.open.pop(at)
        w.add(doc, start, ids[4 * start : 4 * (start + n)], total)
        if gap == n:
            self.emit(w)
        else:
            insort(self.open, (gap - n, order, w))
        return start + n

    def leftovers(self) -> list[Window]:
        return [w for _, _, w in self.open if w.used]


def _rows(window: Window, sequence_id: int, keep_ids: bool) -> Iterator[tuple]:
    offset = 0
    for doc, start, ids, total in window.pieces:
        n = len(ids) // 4
        yield doc, start, n, zlib.crc32(ids), total, sequence_id, offset, ids if keep_ids else None
        offset += n


def merge_leftovers(pieces: list[tuple], size: int = SEQUENCE) -> Iterator[Window]:
    """Fill windows with (doc, start, ids, doc_tokens) one after another; the last is cut at powers of two."""
    w = Window()
    for doc, start, ids, total in pieces:
        while ids:
            n = min(size - w.used, len(ids) // 4)
            w.add(doc, start, ids[: 4 * n], total)
            start, ids = start + n, ids[4 * n :]
            if w.used == size:
                yield w
                w = Window()
    rest, room = w.used, 0
    pieces, w = w.pieces, Window()
    for doc, start, ids, total in pieces:
        while ids:
            if not room:
                room = 1 << (rest.bit_length() - 1)
                rest -= room
            n = min(room, len(ids) // 4)
            w.add(doc, start, ids[: 4 * n], total)
            start, ids, room = start + n, ids[4 * n :], room - n
            if not room:
                yield w
                w = Window()


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, windows: int = WINDOWS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", merged_partitions: int = MERGED_PARTITIONS) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or tokenizer_path()
    source = docs.select(docs[id_col].alias("doc"), text_or_empty(docs, text_col).alias("text"))
    piece = f"doc {dict(source.dtypes)['doc']}, {PIECE}"
    names = ["doc", *[x.split()[0] for x in PIECE.split(", ")]]
    types = arrow_types(piece)
    wide_names, wide_types = [*names, "ids", "part", "place"], [*types, pa.binary(), pa.int64(), pa.int64()]

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, count = TaskContext.get().partitionId(), [], 0

        def emit(w: Window) -> None:
            nonlocal count
            rows.extend((*r, part, 0) for r in _rows(w, (part << 32) + count, False))
            count += 1

        packer = Packer(emit, size, windows)
        for batch in slices(batches):
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                packer.put(doc, document_ids(text, path, end_id))
                if len(rows) >= 10_000:
                    yield record_batch(rows, wide_names, wide_types)
                    rows.clear()
            yield record_batch(rows, wide_names, wide_types)
            rows.clear()
        left = [r for w in packer.leftovers() for r in _rows(w, -1, True)]
        yield record_batch([(*r, part, i) for i, r in enumerate(left)], wide_names, wide_types)

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        rows = sorted(group.select(["part", "place", "doc", "start", "ids", "doc_tokens"]).to_pylist(), key=lambda r: (r["part"], r["place"]))
        pieces = [(r["doc"], r["start"], r["ids"], r["doc_tokens"]) for r in rows]
        out = [r[:-1] for i, w in enumerate(merge_leftovers(pieces, size)) for r in _rows(w, (1 << 62) + (key[0].as_py() << 32) + i, False)]
        return pa.Table.from_batches([record_batch(out, names, types)])

    placed = materialise(source.mapInArrow(online, f"{piece}, ids binary, part long, place long"), "packed")
    done = placed.where(F.col("sequence_id") >= 0).select(*names)
    left = placed.where(F.col("sequence_id") < 0).withColumn("merge_group", F.floor(F.col("part") / merged_partitions) * merged_partitions)
    return done.unionByName(left.groupBy("merge_group").applyInArrow(merge, piece)).withColumnRenamed("doc", id_col)
