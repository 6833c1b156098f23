"""Counts of 64-bit keys over a whole corpus, packed: keys are summed in each task, then in ranges of the key space.

A packed row holds a sorted run of keys (as byte planes, so that the shuffle's compression sees
the shared high bytes together) and their counts. A frequent key is one entry in each run, so no
range holds more of it than there are runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

HELD = 1 << 20  # keys that a task holds before it sums them

PACKED = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType())])


def planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_planes(raw: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the key space, in ascending order."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        found, n = np.unique(keys, return_counts=True)
        return found, n.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


class Run:
    """Gathers keys of one kind in a task and yields packed rows."""

    def __init__(self, kind: int, buckets: int):
        self.kind, self.buckets, self.parts, self.held = kind, buckets, [], 0

    def add(self, keys: np.ndarray):
        self.parts.append(keys)
        self.held += len(keys)
        if self.held >= HELD:
            yield from self.flush()

    def flush(self):
        if not self.held:
            return
        keys, counts = summed(np.concatenate(self.parts))
        self.parts, self.held = [], 0
        cuts = np.searchsorted(bucket_of(keys, self.buckets), np.arange(self.buckets + 1))
        own = np.flatnonzero(np.diff(cuts))
        columns = [[], [], [], []]
        for b in own.tolist():
            k, c = keys[cuts[b] : cuts[b + 1]], counts[cuts[b] : cuts[b + 1]]
            for column, x in zip(columns, (b, len(k), planes(k), planes(c.astype("<u8"))), strict=True):
                column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array([self.kind] * len(own), pa.int32()), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], names=PACKED.names)


def unpack(table) -> tuple[np.ndarray, np.ndarray]:
    """All keys and counts of packed rows, summed and sorted."""
    keys = [from_planes(x, np.uint64) for x in table.column("keys").to_pylist()]
    counts = [from_planes(x, np.uint64).astype(np.int64) for x in table.column("counts").to_pylist()]
    return summed(np.concatenate(keys), np.concatenate(counts))


def reduced(packed: DataFrame, schema: T.StructType, row) -> DataFrame:
    """row(kind, bucket, keys, counts) -> record batch, once for each kind and range."""

    def run(key, table):
        yield row(key[0].as_py(), key[1].as_py(), *unpack(table))

    def whole(key, table):
        return pa.Table.from_batches(list(run(key, table)))

    return packed.groupBy("kind", "bucket").applyInArrow(whole, schema)
