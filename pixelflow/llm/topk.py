"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors stand in blocks; a block keeps, for every dimension, its rows in descending order of
that component (the sorted lists, built once). Queries stand in blocks too, and every query
block meets every row block: each query reads its lists in step, from the end where its
component's product is largest, scores the rows it meets by random access, and stops when the
sum of the products at the lists' current depth, the bound of all unseen rows, is under its
kth score (rows that could tie it are still read). Each block's k best meet in a ranking by query.

Defined results: vectors that are null or hold null or non-finite components take no part; a query meets the vectors of its
own length; equal rows (vec_id and vector) count once; a vec_id with several vectors keeps
all of them as candidates, its least one as query; a query's own vec_id is no candidate; no query gives no row. Scaled
components and scores must fit 64-bit integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

ROWS = 8192
QUERIES = 1024
FIRST_DEPTH = 16

BLOCKS = T.StructType([T.StructField("block", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("rows", T.BinaryType()), T.StructField("lists", T.BinaryType())])
FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, as long."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.where("vec_id is not null").where(fine).select("vec_id", F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _blocks(vectors: DataFrame, size: int, lists: bool) -> DataFrame:
    """Packed blocks of at most `size` rows of one length; a block never waits for another task."""

    def run(frames):
        from pyspark import TaskContext

        task, seq = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list, list]] = {}

        def flush(width):
            nonlocal seq
            ids, rows = held.pop(width)
            both = np.unique(np.column_stack([np.concatenate(ids), np.concatenate(rows)]), axis=0)  # equal rows count once
            i, m = both[:, 0].copy(), both[:, 1:].copy()
            order = np.argsort(-m, axis=0, kind="stable").T.astype(np.uint16 if len(i) <= 65536 else np.uint32) if lists else np.zeros(0, np.uint16)
            out = pa.RecordBatch.from_arrays([pa.array([f"{task}-{seq}"]), pa.array([width], pa.int32()), pa.array([len(i)], pa.int32()), pa.array([i.astype("<i8").tobytes()], pa.binary()), pa.array([m.astype("<i8").tobytes()], pa.binary()), pa.array([np.ascontiguousarray(order).tobytes()], pa.binary())], names=BLOCKS.names)
            seq += 1
            return out

        for frame in frames:
            for lo in range(0, frame.num_rows, size):
                own = frame.slice(lo, size)
                ids = own.column("vec_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
                widths = own.column("v").value_lengths().to_numpy(zero_copy_only=False)
                for width in np.unique(widths).tolist():
                    mine = np.flatnonzero(widths == width)
                    rows = own.column("v").take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(mine), width)
                    if width in held and sum(map(len, held[width][0])) + len(mine) > size:
                        yield flush(width)
                    some = held.setdefault(width, ([], []))
                    some[0].append(ids[mine]), some[1].append(rows)
        for width in list(held):
            yield flush(width)

    return vectors.mapInArrow(run, BLOCKS)


class Lists:
    """A block's vectors and sorted lists."""

    def __init__(self, n: int, ids: bytes, rows: bytes, lists: bytes, width: int):
        self.ids = np.frombuffer(ids, "<i8")
        exact = np.frombuffer(rows, "<i8").reshape(n, width)
        self.big = n and width and int(np.abs(exact).max()) ** 2 * width >= 2**53
        self.rows = exact if self.big else exact.astype(np.float64)  # products in doubles are exact below 2**53
        self.order = np.frombuffer(lists, np.uint16 if n <= 65536 else np.uint32).reshape(width, n)
        self.seen = np.zeros(n, np.int64)
        self.turn = 0

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (ids, scores) by score, then id; and how they were found is the threshold algorithm."""
        n, width = self.order.shape[1], self.order.shape[0]
        q = query if self.big else query.astype(np.float64)
        use = np.flatnonzero(query)
        ids, scores = np.zeros(0, np.int64), np.zeros(0, q.dtype)
        if not len(use):  # every score is 0: the smallest ids win
            own = np.unique(self.ids[self.ids != query_id])[:k]
            return own, np.zeros(len(own), np.int64)
        self.turn += 1
        up = query[use] > 0
        depth, step = 0, FIRST_DEPTH
        while depth < n:
            to = min(n, depth + step)
            met = np.concatenate([self.order[use[up], depth:to].ravel(), self.order[use[~up], n - to : n - depth].ravel()])
            met = met[self.seen[met] != self.turn]
            self.seen[met] = self.turn
            fresh = np.unique(met)
            fresh = fresh[self.ids[fresh] != query_id]
            ids, scores = np.concatenate([ids, self.ids[fresh]]), np.concatenate([scores, self.rows[fresh] @ q])
            if len(ids) > k:
                keep = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[keep], scores[keep]
            depth, step = to, step * 2
            if depth >= n:
                break
            edge = np.where(up, self.order[use, depth], self.order[use, n - 1 - depth])
            bound = (self.rows[edge, use] * q[use]).sum()  # no unseen row scores more
            if len(ids) == k and bound < scores[-1]:
                break
        return ids, scores.astype(np.int64)


def top_k(vectors: DataFrame, k: int = 5, query: str = "vec_id % 50 = 0", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product with every row that `query` picks."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    v = quantised(vectors, scale)
    rows = scratch.save(_blocks(v, ROWS, True), "lists")
    asked = v.where(query).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = scratch.save(_blocks(asked, QUERIES, False), "queries").select("width", F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"))
    # the stated query set against all rows, block by block: a row for each pair of blocks
    names = rows.select(F.col("block").alias("name"), F.col("width").alias("name_width"))
    routed = asked.crossJoin(names).where("width = name_width")
    pairs = rows.drop("width").join(routed, rows["block"] == routed["name"]).select("width", "n", "ids", "rows", "lists", "q_n", "q_ids", "q_rows")

    def run(frames):
        last, own = None, None
        for frame in frames:
            for r in range(frame.num_rows):
                width, n, ids, data, lists, q_n, q_ids, q_rows = (c[r].as_py() for c in frame.columns)
                if last != (ids, data):
                    last, own = (ids, data), Lists(n, ids, data, lists, width)
                who, many = np.frombuffer(q_ids, "<i8"), np.frombuffer(q_rows, "<i8").reshape(q_n, width)
                out: list[tuple] = [(np.full(len(i), who[j]), i, s) for j in range(q_n) for i, s in [own.best(int(who[j]), many[j], k)]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[c] for x in out]), pa.int64()) for c in range(3)], names=FOUND.names)

    # equal rows of different blocks meet here
    found = pairs.mapInArrow(run, FOUND).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
