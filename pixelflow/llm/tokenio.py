"""Token-id files in patched frame-of-reference blocks.

A file is a sequence of segments; a segment is one binary value, holds whole documents, and is

    magic "PFB2" | n documents u32 | n ids u32 | n blocks u32 | documents without a doc_id u32, which come first
    doc_id of each document i64 | its n_tokens u32
    index: start of each block's packed words u32, and of its exceptions u32
    width of each block u8 | exceptions of each block u8 | minimum of each block u32
    packed words u64 | exception places u8 | exception values u32

all little-endian. A block is BLOCK ids less the block's minimum, in as many bits as PERCENTILE
of its values need; the rest of the bits of larger values stand in the exception list.
Segments are rows of a table in the shared folder, written by Spark's committing writer, so a
lost or repeated task leaves no half file. Documents are dealt by ranges of doc_id; each range is one
shard, its segments numbered in ascending doc_id order.

Defined results: null and empty texts have the end id alone; repeated doc_ids keep all their rows (equal
ids stand by text, null first); very long texts make one segment of their own; no documents make no segments.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from . import words as W
from .common import Scratch, partitions

MAGIC = b"PFB2"
BLOCK = 128
PERCENTILE = 0.9
SEGMENT = 1 << 18  # ids in a segment, unless one document has more
END = 0


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that values under 2**32 need."""
    return np.where(x > 0, np.frexp(x.astype(np.float64))[1], 0).astype(np.int64)


def pack(ids: np.ndarray, doc_ids: np.ndarray, counts: np.ndarray, nulls: int = 0) -> bytes:
    """One segment."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.zeros(blocks * BLOCK, np.uint32)
    full[:n] = ids
    if n % BLOCK:
        full[n:] = full[n - 1]
    rows = full.reshape(blocks, BLOCK)
    low = rows.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = rows - low[:, None]
    need = _bits(rest)
    width = np.sort(need, axis=1)[:, int(np.ceil(PERCENTILE * BLOCK)) - 1] if blocks else np.zeros(0, np.int64)
    over = need > width[:, None]
    row, place = np.nonzero(over)
    values = (rest[row, place] >> width[row].astype(np.uint32)).astype("<u4")
    words_at = np.concatenate([[0], np.cumsum(width * BLOCK // 64)]).astype("<u4")
    except_at = np.concatenate([[0], np.cumsum(over.sum(axis=1))]).astype("<u4")
    packed = np.zeros(int(words_at[-1]), np.uint64)
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            cells = (rest[own].astype(np.uint64) & np.uint64((1 << int(w)) - 1)).reshape(len(own) * 2, 64)
            out = np.zeros((len(own) * 2, int(w)), np.uint64)
            for k in range(64):
                at, shift = divmod(k * int(w), 64)
                out[:, at] |= cells[:, k] << np.uint64(shift)
                if shift + w > 64:
                    out[:, at + 1] |= cells[:, k] >> np.uint64(64 - shift)
            packed[(words_at[own].astype(np.int64)[:, None] + np.arange(2 * int(w))).ravel()] = out.ravel()
    head = np.array([len(doc_ids), n, blocks, nulls], "<u4").tobytes()
    return b"".join([MAGIC, head, doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), words_at[:-1].tobytes(), except_at[:-1].tobytes(), width.astype(np.uint8).tobytes(), over.sum(axis=1).astype(np.uint8).tobytes(), low.astype("<u4").tobytes(), packed.astype("<u8").tobytes(), place.astype(np.uint8).tobytes(), values.tobytes()])


class Segment:
    """Reads a segment, whole or block by block through its index."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a token segment")
        docs, self.n, self.blocks, self.nulls = np.frombuffer(raw, "<u4", 4, 4).astype(np.int64)
        at = 20

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.counts = take("<i8", docs), take("<u4", docs)
        self.words_at, self.except_at = take("<u4", self.blocks).astype(np.int64), take("<u4", self.blocks).astype(np.int64)
        self.width, self.exceptions, self.low = take("u1", self.blocks).astype(np.int64), take("u1", self.blocks).astype(np.int64), take("<u4", self.blocks)
        self.packed = take("<u8", int((self.width * BLOCK // 64).sum()))
        total = int(self.exceptions.sum())
        self.place, self.values = take("u1", total), take("<u4", total)

    def read(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of blocks first to last (not included)."""
        last = int(self.blocks) if last is None else last
        out = np.zeros((last - first, BLOCK), np.uint32)
        width = self.width[first:last]
        for w in np.unique(width):
            if w:
                own = np.flatnonzero(width == w)
                source = self.packed[self.words_at[first + own][:, None] + np.arange(2 * int(w))].astype(np.uint64).reshape(len(own) * 2, int(w))
                cells = np.empty((len(own) * 2, 64), np.uint64)
                for k in range(64):
                    at, shift = divmod(k * int(w), 64)
                    cells[:, k] = source[:, at] >> np.uint64(shift)
                    if shift + w > 64:
                        cells[:, k] |= source[:, at + 1] << np.uint64(64 - shift)
                out[own] = (cells & np.uint64((1 << int(w)) - 1)).reshape(len(own), BLOCK)
        n = self.exceptions[first:last]
        if n.sum():
            a = int(self.except_at[first])
            row = np.repeat(np.arange(last - first), n)
            out[row, self.place[a : a + len(row)]] |= self.values[a : a + len(row)].astype(np.uint32) << width[row].astype(np.uint32)
        out += self.low[first:last, None]
        return out.ravel()[: max(0, min(int(self.n) - first * BLOCK, (last - first) * BLOCK))]


class LibraryCodec:
    """The tokenizers library's ids. Matches of its byte-level splitting are encoded once while they repeat.

    added: texts that hold one of the tokenizer's added tokens go to the library whole, as it is loaded;
    else the strings of such tokens are ordinary text.
    """

    def __init__(self, path: str, added: bool = False):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not added
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()] if added else []
        self.matches = bpe.Matches(self._fresh)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.int32, int(counts.sum())), counts

    def _holding(self, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        """Numbers of the texts that hold an added token."""
        found = set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                text = int(np.searchsorted(offsets, at, side="right")) - 1
                if at + len(token) <= offsets[text + 1]:
                    found.add(text)
                    at = raw.find(token, int(offsets[text + 1]))
                else:
                    at = raw.find(token, at + 1)
        return np.array(sorted(found), np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes() if self.added else b""
        whole = self._holding(raw, offsets)
        if not len(whole):
            return self.matches.encode(data, offsets)
        size = np.diff(offsets)
        rest = np.ones(len(size), bool)
        rest[whole] = False
        ids, at = self.matches.encode(data[np.repeat(rest, size)], np.concatenate([[0], np.cumsum(np.where(rest, size, 0))]))
        more, counts = self._library([raw[offsets[k] : offsets[k + 1]].decode("utf-8") for k in whole.tolist()])
        first, n = at[:-1].copy(), np.diff(at)
        first[whole], n[whole] = len(ids) + np.cumsum(counts) - counts, counts
        return bpe.take_runs(np.concatenate([ids, more]), first, n), np.concatenate([[0], np.cumsum(n)])

    def _fresh(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        return self._library([raw[a : a + n].decode("utf-8") for a, n in zip(start.tolist(), length.tolist(), strict=True)])


_codecs: dict[tuple[str, bool], LibraryCodec] = {}


def library_codec(path: str, added: bool = False) -> LibraryCodec:
    if (path, added) not in _codecs:
        _codecs[path, added] = LibraryCodec(path, added)
    return _codecs[path, added]


SEGMENTS = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("before", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("data", T.BinaryType())])


def write(docs: DataFrame, path: str, to: str, segment: int = SEGMENT, added: bool = False) -> None:
    """Encode every text, append the end id, and write segments to the folder `to` in ascending doc_id order.

    added: as in `LibraryCodec`.
    """
    from pyspark import TaskContext

    def run(frames):
        own_codec, shard = library_codec(path, added), TaskContext.get().partitionId()
        seq = before = size = nulls = 0
        ids_of: list[np.ndarray] = []
        docs_of: list[np.ndarray] = []
        counts_of: list[np.ndarray] = []

        def flush():
            nonlocal seq, before, size, nulls
            blob = pack(np.concatenate(ids_of), np.concatenate(docs_of), np.concatenate(counts_of), nulls)
            out = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([seq], pa.int64()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([blob], pa.binary())], names=SEGMENTS.names)
            seq, before, size, nulls = seq + 1, before + size, 0, 0
            ids_of.clear(), docs_of.clear(), counts_of.clear()
            return out

        for frame in frames:
            for own, data, offsets in W.pieces(frame, "text", 1 << 20):
                ids, at = own_codec.encode(data, offsets)
                ids = np.insert(ids, at[1:], END)
                counts = np.diff(at) + 1
                if size and size + len(ids) > segment:
                    yield flush()
                ids_of.append(ids), counts_of.append(counts)
                docs_of.append(own.column("doc_id").cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False))
                nulls += own.column("doc_id").null_count
                size += len(ids)
        if size:
            yield flush()

    n = partitions(docs.sparkSession)
    dealt = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(run, SEGMENTS).write.parquet(to)


def read(spark, path: str, schema: T.StructType, row) -> DataFrame:
    """row(segment, ids, start of the segment's ids in all files) -> record batch, for every segment."""
    rows = spark.read.schema(SEGMENTS).parquet(path)
    shards = rows.groupBy("shard").agg(F.sum("n_ids").alias("total"))  # one row for each shard: as many as there were tasks
    upto = shards.selectExpr("shard", "coalesce(sum(total) over (order by shard rows between unbounded preceding and 1 preceding), 0) as shard_start")

    def run(frames):
        for frame in frames:
            for start, data in zip(frame.column("start").to_pylist(), frame.column("data"), strict=True):
                own = Segment(data.as_py())
                yield row(own, own.read(), start)

    return rows.join(upto, "shard").select((F.col("shard_start") + F.col("before")).alias("start"), "data").mapInArrow(run, schema)


DIGEST = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def _doc_ids(own: Segment) -> pa.Array:
    return pa.array(own.doc_ids, pa.int64(), mask=np.arange(len(own.doc_ids)) < own.nulls)


def digest(docs: DataFrame, path: str, added: bool = False) -> DataFrame:
    """The contract's columns, from files written to the shared folder and read back."""
    spark = docs.sparkSession
    to = Scratch(spark).new_path("token-files")
    write(docs, path, to, added=added)

    def row(own, ids, start):
        upto = np.concatenate([[0], np.cumsum(own.counts.astype(np.int64))])
        raw = np.ascontiguousarray(ids.astype("<u4"))
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(upto[:-1], upto[1:], strict=True)]
        return pa.RecordBatch.from_arrays([_doc_ids(own), pa.array(start + upto[:-1], pa.int64()), pa.array(own.counts, pa.int64()), pa.array(crc, pa.int64())], names=DIGEST.names)

    return read(spark, to, DIGEST, row)


IDS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])


def ids(spark, path: str) -> DataFrame:
    """(doc_id, start, ids with the end id) of every document in token files."""

    def row(own, found, start):
        upto = np.concatenate([[0], np.cumsum(own.counts.astype(np.int64))])
        return pa.RecordBatch.from_arrays([_doc_ids(own), pa.array(start + upto[:-1], pa.int64()), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(found.astype(np.int32)))], names=IDS.names)

    return read(spark, path, IDS, row)
