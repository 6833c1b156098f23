"""Benchmark decontamination: normalised benchmark n-grams as a broadcast hash set.

The benchmark is the bounded side: its texts come to the driver PART_BYTES at a time, and each part is made into an index of
arrays (`Index`: 60 bytes a window and the texts themselves) that is broadcast; a larger benchmark has several parts, each
scanned against all documents, which get a row key first: hit words and items of the parts are
joined by row, and documents are judged and cut once. Training tokens are hashed in windows of the same
length, looked up in a bitmap, then in the sorted hashes, then compared word by word, byte by byte.

Defined results: null or word-free documents have no words and no hits; null or word-free
benchmark items have no windows; items that share an item_id count once, items without one
not (as in the SQL twin); repeated documents each give a row, whatever their doc_id; extra columns of the documents are kept by `remove_documents` and `remove_spans`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import Scratch

WINDOW = 13
PART_BYTES = 8 << 20  # of benchmark text in an index; an item is never cut
COMPARED = 1 << 16  # windows that are compared at a time
ROW = "_decontam_row"


class Windows:
    """The distinct windows of one length: hashes in order, the first word of one place of each, and the items that have it."""

    def __init__(self, index: Index, length: int, first: np.ndarray, hashes: np.ndarray, item: np.ndarray):
        self.length = length
        order = np.argsort(hashes, kind="stable")
        first, hashes, item = first[order], hashes[order], item[order]
        run = np.cumsum(np.append(True, hashes[1:] != hashes[:-1])) - 1
        lead = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        # windows of one hash are one window if their words are the same; others stand behind, each by itself
        alike = index.same(index, first, first[lead][run], length)
        variant = np.zeros(len(first), np.int64)
        variant[~alike] = 1 + np.arange(int((~alike).sum()))
        order = np.lexsort((item, variant, run))
        first, hashes, item, run, variant = first[order], hashes[order], item[order], run[order], variant[order]
        fresh = np.append(True, (run[1:] != run[:-1]) | (variant[1:] != variant[:-1]))
        lead = np.flatnonzero(fresh)
        self.hashes, self.first, self.items = hashes[lead], first[lead], item.astype(np.int32)
        self.items_at = np.append(lead, len(item))
        self.deepest = int(np.bincount(run[lead]).max())  # windows that share a hash
        self.bits = max(10, min(24, (16 * len(lead)).bit_length()))
        self.bitmap = np.zeros(1 << self.bits, bool)
        self.bitmap[self.hashes >> np.uint64(64 - self.bits)] = True


class Index:
    """Windows of benchmark items, by length and hash."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.ids = [i for i, _ in items]
        data, offsets = W.text_bytes(pa.array([t for _, t in items], pa.string()))
        words = W.split(data, offsets, W.ALNUM_WORDS)
        self.low, self.start, self.end = W.padded(W.LOWER[data]), words.start, words.end
        self.by_length: list[Windows] = []
        counts = words.counts
        for length in np.unique(np.minimum(counts[counts > 0], window)).tolist():
            hashes, first = W.grams(words, length)
            item = np.searchsorted(words.first, first, side="right") - 1
            own = (counts[item] == length) | (length == window)
            self.by_length.append(Windows(self, length, first[own], hashes[own], item[own]))

    def same(self, other, first: np.ndarray, others: np.ndarray, length: int) -> np.ndarray:
        """Whether the windows at the first words given, here and in another text, hold the same words."""
        out = np.ones(len(first), bool)
        for lo in range(0, len(first), COMPARED):
            a, b = ((x[lo : lo + COMPARED, None] + np.arange(length)).ravel() for x in (first, others))
            n = self.end[a] - self.start[a]
            alike = n == other.end[b] - other.start[b]
            alike &= W.equal_ranges(self.low, self.start[a], other.low, other.start[b], np.where(alike, n, 0))
            out[lo : lo + COMPARED] = alike.reshape(-1, length).all(axis=1)
        return out

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """Words, mask of hit words, and (text number, item number) pairs."""
        words = W.split(data, offsets, W.ALNUM_WORDS)
        text = Text(W.padded(W.LOWER[data]), words.start, words.end)
        change = np.zeros(len(words.hash) + 1, np.int64)
        pairs = [np.zeros((0, 2), np.int64)]
        for own in self.by_length:
            found, at = W.grams(words, own.length)
            maybe = np.flatnonzero(own.bitmap[found >> np.uint64(64 - own.bits)])
            where = np.searchsorted(own.hashes, found[maybe])
            for _ in range(own.deepest):
                ok = where < len(own.hashes)
                ok[ok] = own.hashes[where[ok]] == found[maybe[ok]]
                maybe, where = maybe[ok], where[ok]
                same = self.same(text, own.first[where], at[maybe], own.length)
                hit, entry = at[maybe[same]], where[same]
                np.add.at(change, hit, 1)
                np.add.at(change, hit + own.length, -1)
                n = own.items_at[entry + 1] - own.items_at[entry]
                doc = np.searchsorted(words.first, hit, side="right") - 1
                item = own.items[np.repeat(own.items_at[entry] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                pairs.append(np.unique(np.column_stack([np.repeat(doc, n), item]), axis=0))
                maybe, where = maybe[~same], where[~same] + 1
        return words, np.cumsum(change[:-1]) > 0, {(d, i) for d, i in np.concatenate(pairs).tolist()}


class Text:
    """Words of texts, as `Index.same` reads them."""

    def __init__(self, low: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.low, self.start, self.end = low, start, end


def _parts(benchmark: DataFrame, window: int, part_bytes: int) -> Iterator[Index]:
    """Indexes of the benchmark's items, one at a time; the last may be of no item."""
    held, size = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        if held and size + len(text.encode()) > part_bytes:
            yield Index(held, window)
            held, size = [], 0
        held.append((item, text))
        size += len(text.encode())
    yield Index(held, window)


def _broadcast(benchmark: DataFrame, window: int, part_bytes: int) -> list:
    """The parts, each broadcast before the next one is read."""
    return [benchmark.sparkSession.sparkContext.broadcast(x) for x in _parts(benchmark, window, part_bytes)]


def _scan(docs: DataFrame, index, schema: T.StructType, row) -> DataFrame:
    def scan(frames):
        for frame in frames:
            for own, data, offsets in W.pieces(frame, "text"):
                yield from row(own, data, offsets, index.value)

    return docs.mapInArrow(scan, schema)


def _items(n: int, index: Index, pairs: set[tuple[int, int]]) -> pa.Array:
    """The distinct ids of each text's items."""
    items: list[set[str]] = [set() for _ in range(n)]
    for doc, item in pairs:
        if index.ids[item] is not None:
            items[doc].add(index.ids[item])
    return pa.array([sorted(x) for x in items], pa.list_(pa.string()))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of each row, written so that every scan sees the same keys."""
    return Scratch(docs.sparkSession).save(docs.withColumn(ROW, F.monotonically_increasing_id()), "keyed")


def _by_row(keyed: DataFrame, parts: list) -> DataFrame:
    """(ROW, doc_id, n_words, items, hit) of every row: what all parts have found together; hit has the places of hit words."""
    kind = T.StructType([T.StructField(ROW, T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("hit", T.ArrayType(T.LongType()))])

    def row(own, data, offsets, index):
        words, hit, pairs = index.scan(data, offsets)
        places = [np.flatnonzero(hit[a:b]) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([own.column(ROW), own.column("doc_id").cast(pa.int64()), pa.array(words.counts, pa.int64()), _items(len(own), index, pairs), pa.array(places, pa.list_(pa.int64()))], names=kind.names)

    narrow = keyed.select(ROW, "doc_id", "text")
    whole = _scan(narrow, parts[0], kind, row)
    for part in parts[1:]:
        whole = whole.union(_scan(narrow, part, kind, row))
    joined = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    return whole.groupBy(ROW).agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(joined("items")).alias("items"), joined("hit").alias("hit"))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items array<string>, contaminated) of every document row.

    A benchmark of several parts is scanned part by part; spans and items of the parts are joined by row key.
    """
    parts = _broadcast(benchmark, window, part_bytes)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))])

    def row(own, data, offsets, index):
        words, hit, pairs = index.scan(data, offsets)
        before = np.concatenate([[0], np.cumsum(hit)])
        yield pa.RecordBatch.from_arrays([own.column("doc_id").cast(pa.int64()), pa.array(words.counts, pa.int64()), pa.array(before[words.first[1:]] - before[words.first[:-1]], pa.int64()), _items(len(own), index, pairs)], names=["doc_id", "n_words", "n_hit", "items"])

    narrow = docs.select("doc_id", "text")
    if len(parts) == 1:
        found = _scan(narrow, parts[0], schema, row)
    else:
        found = _by_row(_keyed(narrow), parts).withColumn("n_hit", F.size("hit").cast("long"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", F.expr("n_hit > 0 and 20 * n_hit >= n_words").alias("contaminated"))


def digest(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The contract's columns, derived from `hits`."""
    return hits(docs, benchmark, **how).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def _cut(own: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, words: W.Words, hit: np.ndarray) -> pa.RecordBatch:
    """own without its hit words and what stands between two of them."""
    before = np.concatenate([[0], np.cumsum(hit)])
    texts = own.column("text").to_pylist()
    for doc in np.flatnonzero(before[words.first[1:]] - before[words.first[:-1]]):
        a, b = words.first[doc], words.first[doc + 1]
        raw, base, at, kept = data[offsets[doc] : offsets[doc + 1]].tobytes(), offsets[doc], 0, []
        for k in np.flatnonzero(hit[a:b]) + a:
            kept.append(raw[at : max(at, words.start[k] - base)] if k == a or not hit[k - 1] else b"")
            at = words.end[k] - base
        texts[doc] = (b"".join(kept) + raw[at:]).decode("utf-8")
    return own.set_column(own.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))


def _edit(docs: DataFrame, benchmark: DataFrame, window: int, part_bytes: int, cut: bool) -> DataFrame:
    """Contaminated documents go, or (cut) every hit span goes, by what all parts have found together."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(docs.schema)
    as_docs = lambda out: pa.RecordBatch.from_arrays([out.column(f.name).cast(f.type) for f in arrow], schema=arrow)
    if len(parts := _broadcast(benchmark, window, part_bytes)) == 1:

        def row(own, data, offsets, index):
            words, hit, _ = index.scan(data, offsets)
            if cut:
                yield as_docs(_cut(own, data, offsets, words, hit))
            else:
                before = np.concatenate([[0], np.cumsum(hit)])
                n_hit = before[words.first[1:]] - before[words.first[:-1]]
                yield as_docs(own.filter(pa.array(~((n_hit > 0) & (20 * n_hit >= words.counts)))))

        return _scan(docs, parts[0], docs.schema, row)

    keyed = _keyed(docs)
    found = _by_row(keyed, parts).where(F.size("hit") > 0)
    if not cut:
        return keyed.join(found.where(20 * F.size("hit") >= F.col("n_words")).select(ROW), ROW, "left_anti").select(*docs.columns)
    places = f"{ROW}_hit"

    def run(frames):
        for frame in frames:
            for own, data, offsets in W.pieces(frame, "text"):
                words = W.split(data, offsets, W.ALNUM_WORDS)
                hit = np.zeros(len(words.hash), bool)
                for first, at in zip(words.first[:-1].tolist(), own.column(places).to_pylist(), strict=True):
                    hit[first + np.array(at or [], np.int64)] = True
                yield as_docs(_cut(own, data, offsets, words, hit))

    return keyed.join(found.select(ROW, F.col("hit").alias(places)), ROW, "left").mapInArrow(run, docs.schema)


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """docs without the contaminated ones (a hit word in 20 or more), in the same columns."""
    return _edit(docs, benchmark, window, part_bytes, False)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """docs with every word of a benchmark window, and what stands between such words, cut out."""
    return _edit(docs, benchmark, window, part_bytes, True)
