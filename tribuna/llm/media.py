"""Media columns: content-addressed payloads in tar shards, metadata from header-only range reads.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are the 8-bit samples of a grey PNG image 64 wide
(lossless; the compressed form is what is stored). Storing is a step of its own that runs once: each task writes tar shards
into the shared folder, and what it returns, the table of pointers, is written there too before anything reads it. So a
later action, however often it runs, stores nothing again. A member is named by the SHA-256 of its bytes and is stored once a
shard, however many rows share it; over all shards `canonical_members` gives one place for each digest. A shard gets a name of
its own for each attempt and appears under it only when complete; pointers are those of the attempts that Spark committed, so
none refers to half a file, and shards that no pointer names (of lost attempts) are listed by `orphan_shards` and can be
deleted. Rows carry digest, shard, offset and length. Width, height and depth are read from the first 33 bytes of a member;
payloads are read back by their range, checked against their digests and turned into features.

Memory: one payload at a time, and a digest table bounded by a shard's size.

Defined cases: null is the empty text, whose payload is 64 zero bytes; equal texts give equal values; a long text is one
member (images have up to 2^31 - 1 rows); ids keep their type and value, repeated and null ones too; an empty table gives no
rows and no shard; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, arrow_types, filesystem, materialise, record_batch, scratch_path, slices, text_or_empty

WIDTH, SHARD_BYTES, LEVEL = 64, 64 << 20, 6
SIGNATURE, HEADER_BYTES, BLOCK = b"\x89PNG\r\n\x1a\n", 33, 512
POINTER = "id {id}, n_bytes long, digest string, shard string, member_offset long, member_length long"
FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload(text: str | None) -> tuple[int, bytes]:
    """(bytes without padding, padded payload)."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw + b"\0" * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_media(samples: bytes, level: int = LEVEL) -> bytes:
    """A grey 8-bit PNG, WIDTH samples a row, no filter."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from a member's first HEADER_BYTES bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a media member")
    return struct.unpack(">IIB", head[16:25])


def decode_media(data: bytes) -> bytes:
    """The samples of an image that encode_media made."""
    _, height, _ = read_header(data)
    at, packed = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered row")
    return lines[:, 1:].tobytes()


def tar_header(name: str, size: int) -> bytes:
    """A ustar header block for a plain file."""
    big = size > 0o77777777777
    length = (b"\x80" + size.to_bytes(11, "big")) if big else b"%011o\0" % size
    head = bytearray(name.encode().ljust(100, b"\0") + b"0000644\0" + b"0000000\0" * 2 + length + b"00000000000\0" + b" " * 8 + b"0" + b"\0" * 100 + b"ustar\00000" + b"\0" * 247)
    head[148:156] = b"%06o\0 " % sum(head)
    return bytes(head)


class ShardWriter:
    """Tar shards of one task; a payload that the shard holds already is not written again."""

    def __init__(self, folder: str, most: int = SHARD_BYTES):
        self.fs, self.path = filesystem(folder)
        self.folder, self.most, self.out, self.done = folder, most, None, []
        self.fs.create_dir(self.path, recursive=True)

    def add(self, media: bytes) -> tuple[str, str, int, int]:
        """(digest, shard, offset, length)."""
        if self.out is None:
            self.name, self.at, self.held = f"{uuid.uuid4().hex}.tar", 0, {}
            self.out = self.fs.open_output_stream(f"{self.path}/{self.name}.part")
        digest = hashlib.sha256(media).hexdigest()
        offset = self.held.get(digest)
        if offset is None:
            self.out.write(tar_header(f"{digest}.png", len(media)))
            self.out.write(media)
            self.out.write(b"\0" * (-len(media) % BLOCK))
            self.held[digest] = offset = self.at + BLOCK
            self.at = offset + len(media) + -len(media) % BLOCK
        return digest, f"{self.folder}/{self.name}", offset, len(media)

    def full(self) -> bool:
        return self.out is not None and self.at >= self.most

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * (2 * BLOCK))
            self.out.close()
            self.fs.move(f"{self.path}/{self.name}.part", f"{self.path}/{self.name}")
            self.out = None


def store_media(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Store all payloads now, once. Returns the written table id, n_bytes, digest, shard, member_offset, member_length."""
    source = docs.select(docs[id_col].alias("id"), text_or_empty(docs, text_col).alias("text"))
    schema = POINTER.format(id=dict(source.dtypes)["id"])
    names, types = ["id", "n_bytes", "digest", "shard", "member_offset", "member_length"], arrow_types(schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, rows = ShardWriter(folder, shard_bytes), []
        for batch in slices(batches):
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                n, samples = payload(text)
                rows.append((i, n, *shards.add(encode_media(samples))))
                if shards.full():
                    shards.close()
                    yield record_batch(rows, names, types)
                    rows = []
        shards.close()
        yield record_batch(rows, names, types)

    return materialise(source.mapInArrow(write, schema), "pointers")


def orphan_shards(folder: str, pointers: DataFrame) -> list[str]:
    """Shards in the folder that no pointer names: left by lost attempts, or not finished. A shard holds many rows, so names are few."""
    fs, path = filesystem(folder)
    from pyarrow.fs import FileSelector

    named = {r["shard"].rsplit("/", 1)[1] for r in pointers.select("shard").distinct().toLocalIterator()}
    there = [f.base_name for f in fs.get_file_info(FileSelector(path, allow_not_found=True))]
    return sorted(f"{folder}/{x}" for x in there if x not in named)


class RangeReader:
    """Byte ranges of shards, the present shard kept open."""

    def __init__(self):
        self.shard, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.shard:
            self.close()
            fs, path = filesystem(shard)
            self.file, self.shard = fs.open_input_file(path), shard
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = self.shard = None


def media_columns(pointers: DataFrame) -> DataFrame:
    """Pointers with width, height and bit_depth; reads HEADER_BYTES bytes a row."""
    at = F.struct("shard", "member_offset").alias("at")

    def make():
        reader = RangeReader()
        return lambda at: read_header(reader.read(at["shard"], at["member_offset"], HEADER_BYTES))

    return add_columns(pointers.select("*", at), "at", make, "width long, height long, bit_depth long", drop=("at",))


def feature_of(samples: bytes) -> str:
    """mean, standard deviation and entropy of the samples, the share of zeros, and the mean step from one to the next."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    step = float(np.abs(np.diff(x.astype(np.int16))).mean())
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={max(0.0, -float((p * np.log2(p)).sum())):.4f};zeros={counts[0] / len(x):.4f};step={step:.4f}"


def media_features(meta: DataFrame) -> DataFrame:
    """Read each payload back by its range, check its digest and size, and compute features."""

    def make():
        reader = RangeReader()

        def compute(m: dict) -> tuple:
            media = reader.read(m["shard"], m["member_offset"], m["member_length"])
            if hashlib.sha256(media).hexdigest() != m["digest"]:
                raise OSError(f"{m['shard']} at {m['member_offset']}: the bytes do not have digest {m['digest']}")
            samples = decode_media(media)
            if len(samples) * 8 != m["width"] * m["height"] * m["bit_depth"]:
                raise OSError(f"{m['shard']} at {m['member_offset']}: the header does not fit the samples")
            return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(media), m["digest"], feature_of(samples)

        return compute

    rows = meta.select("id", "n_bytes", F.struct("digest", "shard", "member_offset", "member_length", "width", "height", "bit_depth").alias("member"))
    return add_columns(rows, "member", make, FEATURES, drop=("member",))


def canonical_members(pointers: DataFrame) -> DataFrame:
    """One place per digest over all shards, for reading or compaction; aggregates before the shuffle."""
    return pointers.groupBy("digest").agg(F.min(F.struct("shard", "member_offset", "member_length")).alias("at")).select("digest", "at.*")


def media_query(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store (now, once), then fill the metadata and read back lazily: narrow passes, no shuffle."""
    folder = folder or scratch_path(docs.sparkSession, "media")
    pointers = store_media(docs, folder, id_col, text_col)
    return media_features(media_columns(pointers)).withColumnRenamed("id", id_col)
