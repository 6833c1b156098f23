"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts.

Counts are taken over every training document. An n-gram (n from 2 to `order`) of count c is
quantised to 1 + floor(log2 c) levels, and each level is an entry of the filter, which is built
in ranges of the key space and broadcast; a count is read by probing level after level
until one is missing. Probabilities are interpolated: P(w | h) = L * c(hw) / c(h) + (1 - L) * P(w | h'),
with h' the shorter history; histories that never occurred leave it to h'. The unigrams are exact.

A training text is part of what it is scored by, so `loo_score` leaves its own counts out: the same
probabilities with the text's own occurrences taken from every count, history and total (not under 0;
n-gram counts as the filter reads them). For held-out texts it is `score`. `loo_mean`, it by tokens, tells texts that occur
once from those that occur again elsewhere.

Both broadcasts are checked: the exact unigram table against `max_table` and the filter against
`max_filter` bytes. Beyond a limit, chunks of texts send their distinct keys to the ranges and get a count
for each back (`joined`): of any size, at about three times the input of disk at most. The
filter's bits don't depend on the way, so scores differ only by the order of addition.

Defined results: null and empty texts are the end token alone; repeated documents each give a row and
each count; no training document gives N = 0, V = 0 and log10(0.1 / 0.1) for every token.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import counts as C
from . import words as W
from .common import Scratch, partitions

END = np.uint64(0x5EED5EED00000001)
BEGIN = np.uint64(0x5EED5EED00000002)
PROBES = 4
BITS_PER_ENTRY = 10
WEIGHT = 0.5
LEVELS = 64


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


@dataclass
class Tokens:
    """Token hashes of texts in a row; an end token closes each text."""

    hash: np.ndarray
    first: np.ndarray

    def grams(self, n: int) -> np.ndarray:
        """For every token the key of the n-gram that it ends; texts are padded with begin tokens."""
        out = self.hash * W.ORDER[n - 1]
        place = np.arange(len(self.hash)) - np.repeat(self.first[:-1], np.diff(self.first))
        for k in range(1, n):
            before = np.full(len(self.hash), BEGIN, np.uint64)
            before[k:] = self.hash[:-k] if k else self.hash
            before[place < k] = BEGIN
            out += before * W.ORDER[n - 1 - k]
        return W.mix(out + np.uint64(n))

    def histories(self, n: int) -> np.ndarray:
        """For every token the key of the n - 1 tokens before it (n > 2), as an (n - 1)-gram ends there."""
        own = self.grams(n - 1)
        place = np.arange(len(self.hash)) - np.repeat(self.first[:-1], np.diff(self.first))
        out = np.empty_like(own)
        out[1:] = own[:-1]
        out[place == 0] = np.uint64(0)
        return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    words = W.split(data, offsets)
    first = words.first + np.arange(len(words.first))
    out = np.full(first[-1], END, np.uint64)
    out[np.arange(len(words.hash)) + words.doc()] = words.hash
    return Tokens(out, first)


def _counted(docs: DataFrame, order: int, buckets: int) -> DataFrame:
    def run(frames):
        runs = [C.Run(n, buckets) for n in range(1, order + 1)]
        for frame in frames:
            for _, data, offsets in W.pieces(frame, "text", 1 << 20):
                t = tokens(data, offsets)
                yield from runs[0].add(t.hash)
                for n in range(2, order + 1):
                    yield from runs[n - 1].add(t.grams(n))
        for r in runs:
            yield from r.flush()

    return docs.where(~held_out(F.col("doc_id"))).select("text").mapInArrow(run, C.PACKED)


PARTS = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("total", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("levels", T.LongType())])


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)  # 1 + floor(log2 c)


def _slots(keys: np.ndarray, level: int, probe: int) -> np.ndarray:
    return W.mix(keys + np.uint64((level * PROBES + probe + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))


def segment(keys: np.ndarray, counts: np.ndarray, bits: int = BITS_PER_ENTRY) -> bytes:
    """The filter's bits for one range of keys."""
    levels = level_of(counts)
    size = max(64, int(levels.sum()) * bits // 8 * 8 + 8)
    out = np.zeros(size, bool)
    for level in range(1, int(levels.max()) + 1 if len(levels) else 1):
        own = keys[levels >= level]
        for probe in range(PROBES):
            out[(_slots(own, level, probe) % np.uint64(size)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


class Filter:
    """The broadcast filter: segments of the ranges one after another."""

    def __init__(self, buckets: int):
        self.buckets, self.data = buckets, bytearray()
        self.at = np.zeros(buckets, np.uint64)
        self.size = np.full(buckets, 64, np.uint64)
        self.full = np.zeros(buckets, bool)

    def put(self, bucket: int, raw: bytes) -> None:
        self.at[bucket], self.size[bucket], self.full[bucket] = len(self.data), len(raw) * 8, True
        self.data += raw

    def seal(self) -> Filter:
        self.data = np.frombuffer(bytes(self.data) or b"\0" * 8, np.uint8)
        return self

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Quantised counts (0 where there is none)."""
        return value_of(self.levels(keys))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels (0 for none), by probing one after another."""
        bucket = C.bucket_of(keys, self.buckets)
        at, size, alive = self.at[bucket], self.size[bucket], np.flatnonzero(self.full[bucket])
        levels = np.zeros(len(keys), np.int64)
        for level in range(1, LEVELS):
            for probe in range(PROBES):
                if not len(alive):
                    break
                bit = _slots(keys[alive], level, probe) % size[alive]
                byte = self.data[(at[alive] + (bit >> np.uint64(3))).astype(np.int64)]
                alive = alive[(byte >> (bit & np.uint64(7)).astype(np.uint8)) & 1 != 0]
            levels[alive] = level
            if not len(alive):
                break
        return levels


def value_of(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its range, 0 for none."""
    return np.where(levels > 0, np.where(levels == 1, 1.0, 0.75 * np.exp2(levels.astype(np.float64)) - 0.5), 0.0)


def _counted_once(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, each token's number among them, and how often its text has its key."""
    unique, back = np.unique(keys, return_inverse=True)
    _, place, times = np.unique(doc * max(1, len(unique)) + back, return_inverse=True, return_counts=True)
    return unique, back, times[place]


def _before(values: np.ndarray, first: np.ndarray, start) -> np.ndarray:
    """For every token the value of the token before it, start for a text's first one."""
    out = np.empty(len(values), np.float64)
    out[1:] = values[:-1]
    out[first[:-1]] = start
    return out


class Model:
    def __init__(self, order: int, total: int, distinct: int, documents: int, keys: np.ndarray, counts: np.ndarray, filters: dict[int, Filter], weight: float):
        self.order, self.total, self.distinct, self.documents, self.weight = order, total, distinct, documents, weight
        self.keys, self.counts, self.filters = keys, counts, filters

    def score(self, data: np.ndarray, offsets: np.ndarray, held: np.ndarray):
        """Of each text: n_tokens, n_known, base score, score, loo score; held: which texts the counts leave out."""
        return scored(tokens(data, offsets), held, self._count, self.order, self.total, self.distinct, self.documents, self.weight)

    def _count(self, n: int, keys: np.ndarray) -> np.ndarray:
        return exact(self.keys, self.counts, keys) if n == 1 else self.filters[n].counts(keys)


def exact(known: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The counts of keys in a sorted table, 0 where there is none."""
    if not len(known):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, counts[at].astype(np.int64), 0)


def scored(t: Tokens, held: np.ndarray, count, order: int, total: int, distinct: int, documents: int, weight: float):
    """Of each text: n_tokens, n_known, base score, score, loo score. count(n, keys): the counts of sorted distinct n-gram keys."""
    n_tokens = np.diff(t.first)
    doc = np.repeat(np.arange(len(n_tokens)), n_tokens)
    inside = ~held[doc]
    unique, back, own = _counted_once(t.hash, doc)
    c = count(1, unique)[back]
    rest = c - own * inside
    p = (c + 0.1) / (total + 0.1 * (distinct + 1))
    loo = (rest + 0.1) / (total - n_tokens[doc] * inside + 0.1 * (distinct + 1))
    base, known = np.log10(p), c > 0
    history, loo_history = _before(c, t.first, documents), _before(rest, t.first, documents - ~held)
    for n in range(2, order + 1):
        unique, back, own = _counted_once(t.grams(n), doc)
        c = count(n, unique)[back]
        rest = np.maximum(0.0, c - own * inside)
        p, loo = interpolated(p, c, history, weight), interpolated(loo, rest, loo_history, weight)
        if n < order:  # a text's first token has one history alone
            history, loo_history = _before(c, t.first, 0), _before(rest, t.first, 0)
    sums = lambda x: np.add.reduceat(x, t.first[:-1]) if len(n_tokens) else x[:0]  # noqa: E731  every text has a token
    return n_tokens, sums(known.astype(np.int64)), sums(base), sums(np.log10(p)), sums(np.log10(loo))


def interpolated(lower: np.ndarray, own: np.ndarray, history: np.ndarray, weight: float) -> np.ndarray:
    seen = history > 0
    share = np.minimum(1.0, own / np.where(seen, history, 1.0))
    return np.where(seen, weight * share + (1 - weight) * lower, lower)


SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("loo_score", T.DoubleType()), T.StructField("loo_mean", T.DoubleType())])


def _rows(doc_id, held_out, total: int, found) -> pa.RecordBatch:
    n, known, *sums = found
    return pa.RecordBatch.from_arrays([doc_id.cast(pa.int64()), held_out, pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), total), pa.int64()), *(pa.array(x, pa.float64()) for x in (*sums, sums[-1] / n))], names=SCORED.names)


def _ngrams(docs: DataFrame, order: int, scratch: Scratch, buckets: int, bits: int) -> DataFrame:
    """PARTS of the training documents: exact unigrams and the filter's segments, by ranges of keys."""

    def part(kind, bucket, keys, counts):
        blob = (C.planes(keys), C.planes(counts.astype("<u8"))) if kind == 1 else (segment(keys, counts, bits), b"")
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.array([blob[0]], pa.binary()), pa.array([blob[1]], pa.binary()), pa.array([int(level_of(counts).sum())], pa.int64())], names=PARTS.names)

    return scratch.save(C.reduced(_counted(docs, order, buckets), PARTS, part), "ngrams")


def scores(docs: DataFrame, order: int = 2, weight: float = WEIGHT, max_table: int = 160 << 20, max_filter: int = 256 << 20, bits: int = BITS_PER_ENTRY) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, loo_score, loo_mean) of every document row."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    buckets = 4 * partitions(spark)
    parts = _ngrams(docs, order, scratch, buckets, bits)
    sizes = {r["kind"]: r for r in parts.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum(F.length("keys")).alias("bytes")).collect()}
    total, distinct = (sizes[1]["total"], sizes[1]["n"]) if 1 in sizes else (0, 0)
    if distinct * 16 > max_table or sum(r["bytes"] for k, r in sizes.items() if k > 1) > max_filter:
        return joined(docs, order, weight, parts)
    keys, counts, filters = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], {n: Filter(buckets) for n in range(2, order + 1)}
    documents = 0
    for r in parts.orderBy("kind", "bucket").toLocalIterator():
        if r["kind"] == 1:
            keys.append(C.from_planes(bytes(r["keys"]), np.uint64))
            counts.append(C.from_planes(bytes(r["counts"]), np.uint64))
            documents += int(counts[-1][keys[-1] == END].sum())
            counts[-1] = np.minimum(counts[-1], np.iinfo(np.uint32).max).astype(np.uint32) if counts[-1].max() <= np.iinfo(np.uint32).max else counts[-1]
        else:
            filters[r["kind"]].put(r["bucket"], bytes(r["keys"]))
    model = spark.sparkContext.broadcast(Model(order, total, distinct, documents, np.concatenate(keys), np.concatenate(counts), {n: f.seal() for n, f in filters.items()}, weight))
    del keys, counts, filters

    def run(frames):
        own = model.value
        for frame in frames:
            for part, data, offsets in W.pieces(frame, "text", 1 << 20):
                held = part.column("held_out")
                yield _rows(part.column("doc_id"), held, own.total, own.score(data, offsets, held.to_numpy(zero_copy_only=False).astype(bool)))

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, SCORED)


TEXTS = "chunk long, seq long, doc_id long, held_out boolean, text string"
ASKED = "kind int, bucket int, chunk long, seq long, keys binary"
ANSWERS = "kind int, bucket int, chunk long, seq long, found binary"


def _chunks(docs: DataFrame, limit: int) -> DataFrame:
    """TEXTS: all rows, in numbered chunks of at most `limit` bytes of text or a single longer text; seq counts a chunk's rows."""

    def run(frames):
        from pyspark import TaskContext

        chunk, held, seq = TaskContext.get().partitionId() << 32, 0, 0
        for frame in frames:
            _, offsets = W.text_bytes(frame.column("text"))
            chunks, seqs = np.empty(frame.num_rows, np.int64), np.empty(frame.num_rows, np.int64)
            for k, size in enumerate(np.diff(offsets).tolist()):
                if seq and held + size + 1 > limit:
                    chunk, held, seq = chunk + 1, 0, 0
                chunks[k], seqs[k] = chunk, seq
                held, seq = held + size + 1, seq + 1
            yield pa.RecordBatch.from_arrays([pa.array(chunks), pa.array(seqs), frame.column("doc_id").cast(pa.int64()), frame.column("held_out"), frame.column("text").cast(pa.string())], names=["chunk", "seq", "doc_id", "held_out", "text"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, TEXTS)


def _runs(frames):
    """(chunk, seq of the first row, rows): the rows of a task cut where the chunk changes or its rows don't go on."""
    held, last = [], None
    for frame in frames:
        if not frame.num_rows:
            continue
        chunk, seq = frame.column("chunk").to_numpy(), frame.column("seq").to_numpy()
        go_on = (chunk[1:] == chunk[:-1]) & (seq[1:] == seq[:-1] + 1)
        cuts = [0, *(np.flatnonzero(~go_on) + 1).tolist(), frame.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and (chunk[lo], seq[lo] - 1) != last:
                yield _run(held)
                held = []
            held.append(frame.slice(lo, hi - lo))
            last = (chunk[hi - 1], seq[hi - 1])
    if held:
        yield _run(held)


def _run(held: list):
    table = pa.Table.from_batches(held)
    return table.column("chunk")[0].as_py(), table.column("seq")[0].as_py(), table


def _asked(texts: DataFrame, order: int, buckets: int) -> DataFrame:
    """ASKED: the distinct n-gram keys of every run, sorted and cut by ranges."""

    def run(frames):
        for chunk, seq, table in _runs(frames):
            t = tokens(*W.text_bytes(table.column("text")))
            for n in range(1, order + 1):
                keys = np.unique(t.hash if n == 1 else t.grams(n))
                cuts = np.searchsorted(C.bucket_of(keys, buckets), np.arange(buckets + 1))
                own = np.flatnonzero(np.diff(cuts)).tolist()
                same = lambda x, kind=pa.int64(), size=len(own): pa.array(np.full(size, x), kind)
                yield pa.RecordBatch.from_arrays([same(n, pa.int32()), pa.array(own, pa.int32()), same(chunk), same(seq), pa.array([C.planes(keys[cuts[b] : cuts[b + 1]]) for b in own], pa.binary())], names=["kind", "bucket", "chunk", "seq", "keys"])

    return texts.select("chunk", "seq", "text").mapInArrow(run, ASKED)


def _answered(asked: DataFrame, parts: DataFrame, buckets: int) -> DataFrame:
    """ANSWERS: for every row asked, in its order, counts of unigrams and levels of n-grams; each range is read by its own task."""

    def run(key, own, found):
        kind, bucket = key[0].as_py(), key[1].as_py()
        raw = own.column("keys").to_pylist()
        keys = [C.from_planes(x, np.uint64) for x in raw]
        cuts = np.cumsum([0, *map(len, keys)]).tolist()
        keys = np.concatenate([*keys, np.zeros(0, np.uint64)])
        if not found.num_rows:
            out = np.zeros(len(keys), np.int64 if kind == 1 else np.uint8)
        elif kind == 1:
            out = exact(*(C.from_planes(found.column(c)[0].as_py(), np.uint64) for c in ("keys", "counts")), keys)
        else:
            one = Filter(buckets)
            one.put(bucket, found.column("keys")[0].as_py())
            out = one.seal().levels(keys).astype(np.uint8)
        packed = [C.planes(out[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]
        return pa.table([*(own.column(c) for c in ("kind", "bucket", "chunk", "seq")), pa.array(packed, pa.binary())], names=["kind", "bucket", "chunk", "seq", "found"])

    return asked.groupBy("kind", "bucket").cogroup(parts.select("kind", "bucket", "keys", "counts").groupBy("kind", "bucket")).applyInArrow(run, ANSWERS)


def joined(docs: DataFrame, order: int = 2, weight: float = WEIGHT, parts: DataFrame | None = None, bits: int = BITS_PER_ENTRY, chunk_bytes: int = 4 << 20) -> DataFrame:
    """The same columns for tables of any size: no task and no broadcast holds the model. `parts` is deleted.

    Texts are written once in chunks. Each chunk asks every range of keys once for its distinct keys, and the ranges answer
    with counts (unigrams) or levels (n-grams) in the order asked, so that answers go back without keys; then texts and
    answers meet by chunk. Should a reader split a chunk, each run of its rows asks for itself.
    parts: `_ngrams` of the documents, if there already.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    buckets = 4 * partitions(spark)
    if parts is None:
        parts = _ngrams(docs, order, scratch, buckets, bits)
    sizes = parts.where("kind = 1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    distinct, total = (int(x) for x in sizes)
    end = parts.where((F.col("kind") == 1) & (F.col("bucket") == int(C.bucket_of(np.array([END]), buckets)[0]))).select("keys", "counts").first()
    documents = int(exact(*(C.from_planes(bytes(x), np.uint64) for x in end), np.array([END]))[0]) if end else 0
    texts = scratch.save(_chunks(docs, chunk_bytes), "texts")
    answers = scratch.save(_answered(_asked(texts, order, buckets), parts, buckets), "answers")
    scratch.drop(parts)
    scratch.collect_shuffles()  # before texts and answers are dealt out

    def run(key, own, said):
        own = own.take(pa.array(np.argsort(own.column("seq").to_numpy())))
        seq, out = own.column("seq").to_numpy(), []
        first, kind, bucket = (said.column(c).to_numpy() for c in ("seq", "kind", "bucket"))
        in_order, found = np.argsort(bucket), said.column("found")
        starts = np.unique(first)
        ends = np.append(np.searchsorted(seq, starts[1:]), len(seq))
        for start, lo, hi in zip(starts, np.searchsorted(seq, starts).tolist(), ends.tolist()):
            rows = own.slice(lo, hi - lo)

            def count(n, keys, start=start):
                here = in_order[(first[in_order] == start) & (kind[in_order] == n)]
                got = np.concatenate([C.from_planes(x, np.int64 if n == 1 else np.uint8) for x in found.take(pa.array(here)).to_pylist()])
                if len(got) != len(keys):
                    raise ValueError("a chunk's answers don't fit its keys")
                return got if n == 1 else value_of(got.astype(np.int64))

            held = rows.column("held_out").combine_chunks()
            found_rows = scored(tokens(*W.text_bytes(rows.column("text"))), held.to_numpy(zero_copy_only=False).astype(bool), count, order, total, distinct, documents, weight)
            out.append(_rows(rows.column("doc_id").combine_chunks(), held, total, found_rows))
        return pa.Table.from_batches(out)

    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, SCORED)
