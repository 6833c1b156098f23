"""Byte-level BPE in length-bucketed padded numpy matrices, with exact decoding.

Pattern matches are found per batch (see pretok), repeated ones (equal byte by byte) are encoded once, and new
ones go into matrices of rows of like length. Each round, every row looks up the ranks of its
neighbouring pairs in an open-addressed hash table, merges its leftmost pair of least
rank, and closes the gap; rows without such a pair leave the matrix.

Defined results: null and empty texts have no ids and decode to no bytes; repeated
documents each give a row; texts of any length are encoded whole, in memory in proportion
to one text. Extra columns take no part.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import pretok
from . import words as W

NONE = np.int32(2**31 - 1)
CELLS = 1 << 20  # cells of a matrix at most
CACHE = 400_000  # matches that are kept between batches
CACHE_BYTES = 1 << 23  # and their bytes
LONG = 2048  # bytes of a match over which a heap finds the same leftmost least pairs


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """(left id, right id) -> merged id, in an open-addressed table of 64-bit keys."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        values = np.array(merged, np.int32)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, ~np.uint64(0), np.uint64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        self.rows: dict[int, int] = {}
        todo, self.probes = np.arange(len(keys)), 0
        while len(todo):
            at = self._slot(keys[todo], self.probes)
            free = self.keys[at] == ~np.uint64(0)
            _, winner = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            winner = winner[free[winner]]
            self.keys[at[winner]], self.values[at[winner]] = keys[todo[winner]], values[todo[winner]]
            todo = np.delete(todo, winner)
            self.probes += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return ((W.mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def single(self, left: int, right: int) -> int:
        """find() of one pair, for long matches."""
        if not self.rows:
            used = self.keys != ~np.uint64(0)
            self.rows = dict(zip(self.keys[used].tolist(), self.values[used].tolist(), strict=True))
        return self.rows.get(left << 32 | right, int(NONE))

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where the pair doesn't merge."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        out = np.full(len(keys), NONE, np.int32)
        at = self._slot(keys, 0)
        todo = np.arange(len(keys))
        for _ in range(self.probes):
            here = self.keys[at[todo]]
            hit = here == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (here != ~np.uint64(0))]
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return out


class Matches:
    """Encodes each distinct match of the pattern once while it repeats; matches are the same only if their bytes are.

    fresh(bytes, starts, lengths) -> (ids of these matches in a row, count of each).
    """

    def __init__(self, fresh):
        self.fresh = fresh
        self.hash = np.zeros(0, np.uint64)  # sorted; the others are in its order
        self.at, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)  # in ids
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)  # in bytes
        self.ids, self.bytes = np.zeros(0, np.int32), np.zeros(0, np.uint8)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of each text's ids."""
        start = pretok.split(data, offsets)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        length = np.diff(np.append(start, len(data)))
        both = W.padded(np.concatenate([self.bytes, data]))
        begin = start + len(self.bytes)
        unique, first, back = np.unique(W.hashed(both, begin, begin + length), return_index=True, return_inverse=True)
        where = np.minimum(np.searchsorted(self.hash, unique), max(0, len(self.hash) - 1))
        new = self.hash[where] != unique if len(self.hash) else np.ones(len(unique), bool)
        ids, counts = self.fresh(data, start[first[new]], length[first[new]])
        at, n, spot, size = (np.empty(len(unique), np.int64) for _ in range(4))
        at[new], n[new], spot[new], size[new] = np.cumsum(counts) - counts + len(self.ids), counts, begin[first[new]], length[first[new]]
        if len(self.hash):
            old = where[~new]
            at[~new], n[~new], spot[~new], size[~new] = self.at[old], self.n[old], self.start[old], self.length[old]
        store = np.concatenate([self.ids, ids])
        # a match of the same hash but other bytes than its representative is encoded by itself
        each_at, each_n = at[back], n[back]
        alike = size[back] == length
        check = np.flatnonzero(alike & (length > W.EXACT))  # up to there, hashes and lengths are the bytes
        alike[check] = W.equal_ranges(both, begin[check], both, spot[back[check]], length[check])
        if not alike.all():
            odd = np.flatnonzero(~alike)
            more, counts = self.fresh(data, start[odd], length[odd])
            each_at[odd], each_n[odd] = len(store) + np.cumsum(counts) - counts, counts
            out = take_runs(np.concatenate([store, more]), each_at, each_n)
        else:
            out = take_runs(store, each_at, each_n)
        upto = np.concatenate([[0], np.cumsum(each_n)])
        if len(self.hash) + int(new.sum()) <= CACHE and len(self.bytes) + int(size[new].sum()) <= CACHE_BYTES:
            kept = np.concatenate([self.bytes, take_runs(data, start[first[new]], size[new])])
            spot[new] = np.cumsum(size[new]) - size[new] + len(self.bytes)
            order = np.argsort(np.concatenate([self.hash, unique[new]]), kind="stable")
            self.hash = np.concatenate([self.hash, unique[new]])[order]
            self.at, self.n, self.start, self.length = (np.concatenate([x, y[new]])[order] for x, y in ((self.at, at), (self.n, n), (self.start, spot), (self.length, size)))
            self.ids, self.bytes = store, kept
        return out, upto[np.searchsorted(start, offsets)]


class Codec:
    def __init__(self, ranks: dict[bytes, int]):
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_at = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        self.matches = Matches(self.encode_matches)

    def merge(self, matrix: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rows of ids (padded on the right) until no pair merges; the ids of all rows and the rows' lengths."""
        done = np.zeros_like(matrix)
        final = lengths.copy()
        rows = np.arange(len(matrix))
        ranks = np.full((len(matrix), max(1, matrix.shape[1] - 1)), NONE, np.int32)
        if matrix.shape[1] > 1:
            inside = np.arange(matrix.shape[1] - 1) < lengths[:, None] - 1
            i, j = np.nonzero(inside)
            ranks[i, j] = self.pairs.find(matrix[i, j], matrix[i, j + 1])
        while len(rows):
            at = ranks.argmin(axis=1)  # the leftmost of the least
            every = np.arange(len(rows))
            best = ranks[every, at]
            over = best == NONE
            if over.any():
                done[rows[over], : matrix.shape[1]] = matrix[over]
                final[rows[over]] = lengths[over]
                keep = ~over
                rows, matrix, ranks, lengths, at, best = rows[keep], matrix[keep], ranks[keep], lengths[keep], at[keep], best[keep]
                if not len(rows):
                    break
                every = np.arange(len(rows))
            lengths = lengths - 1
            width = int(lengths.max())
            # close the gap behind the merged pair
            column = np.arange(width)
            matrix = np.where(column <= at[:, None], matrix[:, :width], matrix[:, 1 : width + 1])
            matrix[every, at] = best
            column = column[: max(1, width - 1)]
            moved = np.full((len(rows), max(1, width - 1)), NONE, np.int32)
            shifted = ranks[:, 1 : len(column) + 1]
            moved[:, : shifted.shape[1]] = np.where(column[: shifted.shape[1]] < at[:, None], ranks[:, : shifted.shape[1]], shifted)
            ranks = moved
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.pairs.find(matrix[left, at[left] - 1], best[left])
            right = np.flatnonzero(at + 1 < lengths)
            ranks[right, at[right]] = self.pairs.find(best[right], matrix[right, at[right] + 1])
            end = np.flatnonzero(at + 1 >= lengths)
            if ranks.shape[1] and len(end):
                inside = at[end] < ranks.shape[1]
                ranks[end[inside], at[end[inside]]] = NONE
        mask = np.arange(done.shape[1]) < final[:, None]
        return done[mask], final

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """The same merges of one long match, in a heap of (rank, place)."""
        n, own = len(ids), ids.tolist()
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i, r in enumerate(self.pairs.find(ids[:-1], ids[1:]).tolist()) if r != NONE]
        heapq.heapify(heap)
        alive = [True] * n
        one = self.pairs.single
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or one(own[i], own[j]) != rank:
                continue
            own[i], after[i], alive[j] = rank, after[j], False
            if after[i] >= 0:
                before[after[i]] = i
                if (r := one(rank, own[after[i]])) != NONE:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := one(own[before[i]], rank)) != NONE:
                heapq.heappush(heap, (r, before[i]))
        return np.array([x for x, a in zip(own, alive, strict=True) if a], np.int32)

    def encode_matches(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every match, in the order given, and their counts."""
        order = np.argsort(length, kind="stable")
        parts: list[np.ndarray] = []
        counts = np.empty(len(start), np.int64)
        lo = 0
        while lo < len(order):
            short = int(length[order[lo]])
            if short > LONG:
                ids = self.merge_long(self.byte_ids[data[start[order[lo]] : start[order[lo]] + short]])
                parts.append(ids)
                counts[order[lo]] = len(ids)
                lo += 1
                continue
            hi = int(np.searchsorted(length[order], min(LONG, max(short + 2, short * 5 // 4)), side="right"))
            hi = min(hi, lo + max(1, CELLS // max(1, int(length[order[hi - 1]]))))
            own = order[lo:hi]
            width = int(length[own].max())
            cell = np.minimum(start[own][:, None] + np.arange(width), len(data) - 1)
            ids, final = self.merge(self.byte_ids[data[cell]], length[own])
            parts.append(ids)
            counts[own] = final
            lo = hi
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        at = np.concatenate([[0], np.cumsum(counts[order])])[:-1]
        back = np.empty(len(order), np.int64)
        back[order] = at
        return take_runs(ids, back, counts), counts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of each text's ids."""
        return self.matches.encode(data, offsets)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all id sequences in a row, and the offsets of each sequence's bytes."""
        n = (self.token_at[1:] - self.token_at[:-1])[ids]
        upto = np.concatenate([[0], np.cumsum(n)])
        return take_runs(self.token_bytes, self.token_at[ids], n), upto[offsets]


def take_runs(values: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """values[at[i] : at[i] + n[i]] for every i, one after another."""
    total = int(n.sum())
    if not total:
        return values[:0]
    upto = np.cumsum(n)
    index = np.repeat(at - (upto - n), n)
    index += np.arange(total)
    return values[index]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a rank file, made once in each worker."""
    if path not in _codecs:
        _codecs[path] = Codec(load_ranks(path))
    return _codecs[path]


ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
TOKENS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
DIGEST = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def _each(docs: DataFrame, path: str, schema: T.StructType, row) -> DataFrame:
    def run(frames):
        own_codec = codec(path)
        for frame in frames:
            for own, data, offsets in W.pieces(frame, "text", 1 << 20):
                ids, at = own_codec.encode(data, offsets)
                decoded, decoded_at = own_codec.decode(ids, at)
                yield row(own.column("doc_id").cast(pa.int64()), ids, at, decoded, decoded_at)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of every document row; path: a rank file that every worker can open."""

    def row(doc_id, ids, at, decoded, decoded_at):
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
        blobs = pa.array([decoded[a:b].tobytes() for a, b in zip(decoded_at[:-1], decoded_at[1:], strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([doc_id, lists, blobs], names=ENCODED.names)

    return _each(docs, path, ENCODED, row)


def _sha(x: np.ndarray, upto: np.ndarray) -> pa.Array:
    return pa.array([hashlib.sha256(x[a:b]).hexdigest() for a, b in zip(upto[:-1], upto[1:], strict=True)], pa.string())


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every document row."""

    def row(doc_id, ids, at, decoded, decoded_at):
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
        return pa.RecordBatch.from_arrays([doc_id, pa.array(np.diff(at), pa.int64()), lists, _sha(ids.astype("<u4"), at), _sha(np.ascontiguousarray(decoded), decoded_at)], names=TOKENS.names)

    return _each(docs, path, TOKENS, row)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """The contract's columns of every document row, taken from its ids and decoded bytes."""

    def row(doc_id, ids, at, decoded, decoded_at):
        return pa.RecordBatch.from_arrays([doc_id, pa.array(np.diff(at), pa.int64()), _sha(ids.astype("<u4"), at), _sha(np.ascontiguousarray(decoded), decoded_at)], names=DIGEST.names)

    return _each(docs, path, DIGEST, row)
