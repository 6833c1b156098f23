"""N-gram Jaccard join: a size-aware heavy-light set join over word shingles, and its components.

A text's set holds the 64-bit hashes of its distinct shingles of N words (with fewer words, of the whole sequence).
Two sets link when 9 * overlap >= 4 * (size + size), that is, at a Jaccard similarity of 0.8 or more.

1. Pruning. A set of n shingles can link only if 0.8 n of them occur in other sets. Shingles are
   packed with text numbers in runs, dealt by ranges of the hash, counted, and only the number of shared
   shingles goes back to each text. Nothing is decided by a count but who cannot link at all.
2. Classes. Texts with equal sets are one class, of its least doc_id; the classes' sets are pruned once more among themselves.
3. Light sets (up to a size that a cost model picks) list all their subsets of the overlap that
   each possible partner size calls for; classes that share a subset link. Heavy sets, and light ones that a heavy one
   could link to, are entries of inverted lists over their prefixes (rarer shingles first); who shares no list cannot link.
4. Lists are scanned twice. First every entry meets its list's least class: a star, no matter how long
   the list. The links found give components. Then entries of lists that still hold several components meet the entries
   outside of their own. Pairs must be possible by sizes, shared counts and bit maps; those that are get checked on whole sets.

Pairs of one component are never needed again, so a group of near copies costs its size, not its square.

Defined results: null, empty and word-free texts have an empty set, n_shingles 0 and their own component; a null doc_id
has a null component and links with nothing; doc_id is taken as unique: rows that repeat it each appear, with the least component of them all;
other columns, whatever their names, are kept by `keep_one`. 64-bit hashes (`words.hashed`, not linear in the bytes) stand for shingles: of two texts
with 1,000 shingles each, one pair in about 10**13 would gain a false match.
"""

from __future__ import annotations

import hashlib
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import counts as C
from . import graph
from . import words as W
from .common import Scratch, partitions

N = 5
RUN = 1 << 20  # shingles in a run
LIGHTEST, LIGHT_MOST = 1, 16  # bounds of the light sizes
SCAN_COST = 8.0  # an entry of an inverted list against a subset's
RARE = 1 / 1000  # a shingle of more of the sets than this goes to the end of prefixes


def sets_of(data: np.ndarray, offsets: np.ndarray, n: int = N) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    words = W.split(data, offsets)
    hashes, at = W.grams(words, n)
    cuts = np.searchsorted(at, words.first)
    out = [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    for doc in np.flatnonzero((words.counts > 0) & (words.counts < n)).tolist():
        a, b = int(words.first[doc]), int(words.first[doc + 1])
        own = W.Words(words.start[a:b], words.end[a:b], words.hash[a:b], np.array([0, b - a]))
        out[doc] = W.grams(own, b - a)[0]
    return out


def least_overlap(s, t):
    """The overlap that sizes s and t need to link."""
    return -(-4 * (s + t) // 9)


def prefix_length(s):
    return s - (-(-4 * s // 5)) + 1


RUNS = T.StructType([T.StructField("run", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("keys", T.BinaryType()), T.StructField("docs", T.BinaryType()), T.StructField("ids", T.BinaryType()), T.StructField("sizes", T.BinaryType()), T.StructField("digests", T.BinaryType())])
SHARED = T.StructType([T.StructField("run", T.StringType()), T.StructField("ids", T.BinaryType()), T.StructField("sizes", T.BinaryType()), T.StructField("digests", T.BinaryType()), T.StructField("shared", T.BinaryType())])
COUNTED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("shared", T.LongType()), T.StructField("digest", T.BinaryType())])
NO_ID = np.iinfo(np.int64).min


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _shared(rows: DataFrame, of_batch, scratch: Scratch) -> DataFrame:
    """(doc_id, n, shared, digest) of every row: its set's size, how many of its shingles another row has too, and its set's digest.

    of_batch(record batch) yields (ids, sets). 32 bits of a hash are kept beside its range, so
    `shared` may be too large by a few in a billion, never too small.
    """
    buckets = 4 * partitions(rows.sparkSession)

    def run(frames):
        from pyspark import TaskContext

        task, seq, held, ids, sets = TaskContext.get().partitionId(), 0, 0, [], []

        def flush():
            nonlocal seq, held
            sizes = np.array([len(s) for s in sets], np.int64)
            keys, docs = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
            order = np.argsort(keys, kind="stable")
            keys, docs = keys[order], docs[order]
            cuts = np.searchsorted(C.bucket_of(keys, buckets), np.arange(buckets + 1))
            own = np.flatnonzero(np.diff(cuts))
            name = f"{task}-{seq}"
            low = (W.mix(keys) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            columns: list[list] = [[], [], []]
            for b in own.tolist():
                part = np.argsort(low[cuts[b] : cuts[b + 1]], kind="stable") + cuts[b]
                for column, x in zip(columns, (b, C.planes(low[part]), C.planes(docs[part])), strict=True):
                    column.append(x)
            none = [None] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary()), *(pa.array(none, pa.binary()) for _ in range(3))], names=RUNS.names)
            whole = [np.concatenate(ids).astype("<i8").tobytes(), sizes.astype("<i8").tobytes(), b"".join(hashlib.blake2b(s, digest_size=16).digest() for s in sets)]
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([-1 - (hash((task, seq)) % buckets)], pa.int32()), pa.array([None], pa.binary()), pa.array([None], pa.binary()), *(pa.array([x], pa.binary()) for x in whole)], names=RUNS.names)
            seq, held = seq + 1, 0
            ids.clear(), sets.clear()

        for frame in frames:
            for own_ids, own_sets in of_batch(frame):
                ids.append(own_ids)
                sets.extend(own_sets)
                held += sum(map(len, own_sets)) + len(own_sets)
                if held >= RUN:
                    yield from flush()
        if sets:
            yield from flush()

    def count(key, table):
        names = table.column("run").to_pylist()
        if key[0].as_py() < 0:
            return pa.table([table.column("run"), table.column("ids"), table.column("sizes"), table.column("digests"), pa.array([None] * len(names), pa.binary())], names=SHARED.names)
        keys = [C.from_planes(x, np.uint32) for x in table.column("keys").to_pylist()]
        docs = [C.from_planes(x, np.uint32) for x in table.column("docs").to_pylist()]
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        same = ordered[1:] == ordered[:-1]
        twice = np.empty(len(every), bool)
        twice[order] = np.append(same, False) | np.append(False, same) if len(every) else False
        out, at = [], 0
        for d in docs:
            mark = twice[at : at + len(d)]
            at += len(d)
            out.append(C.planes(np.bincount(d[mark], minlength=int(d.max()) + 1).astype(np.uint32)))
        none = pa.array([None] * len(names), pa.binary())
        return pa.table([table.column("run"), none, none, none, pa.array(out, pa.binary())], names=SHARED.names)

    def gather(key, table):
        ids = sizes = digests = None
        parts = []
        for i, s, d, x in zip(*(table.column(c).to_pylist() for c in ("ids", "sizes", "digests", "shared")), strict=True):
            if i is not None:
                ids, sizes, digests = np.frombuffer(i, "<i8"), np.frombuffer(s, "<i8"), d
            else:
                parts.append(C.from_planes(x, np.uint32))
        total = np.zeros(len(ids), np.int64)
        for p in parts:
            total[: len(p)] += p
        return pa.table([pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(sizes, pa.int64()), pa.array(total, pa.int64()), pa.array([digests[k : k + 16] for k in range(0, len(digests), 16)], pa.binary())], names=COUNTED.names)

    each = rows.mapInArrow(run, RUNS).groupBy("bucket").applyInArrow(count, SHARED)
    return scratch.save(each.groupBy("run").applyInArrow(gather, COUNTED), "shared")


SETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("set", T.BinaryType())])


def _texts(n: int):
    def of_batch(frame):
        for own, data, offsets in W.pieces(frame, "text", 1 << 21):
            yield _ids(own.column("doc_id")), sets_of(data, offsets, n)

    return of_batch


def _packed(frame):
    yield _ids(frame.column("doc_id")), [np.frombuffer(x, "<u8") for x in frame.column("set").to_pylist()]


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def run(frames):
        for frame in frames:
            for own, data, offsets in W.pieces(frame, "text", 1 << 21):
                raw = [s.astype("<u8").tobytes() for s in sets_of(data, offsets, n)]
                yield pa.RecordBatch.from_arrays([own.column("doc_id").cast(pa.int64()), pa.array([len(x) // 8 for x in raw], pa.int64()), pa.array(raw, pa.binary())], names=SETS.names)

    return docs.select("doc_id", "text").mapInArrow(run, SETS)


def light_size(histogram: dict[int, int]) -> int:
    """The largest light size: the one with the least cost of all subsets and list entries."""
    best, least = 0, None
    for x in range(0, LIGHT_MOST + 1):
        cost = 0.0
        for s, many in histogram.items():
            if LIGHTEST <= s <= x:
                cost += many * sum(comb(s, least_overlap(s, t)) for t in partners(s) if t <= x)
            if s > x or any(t > x for t in partners(s)):
                cost += many * SCAN_COST * prefix_length(s)
        if least is None or cost < least:
            best, least = x, cost
    return best


def partners(s: int) -> range:
    """Sizes that a set of s can link to."""
    return range(-(-4 * s // 5), 5 * s // 4 + 1)


ENTRIES = T.StructType([T.StructField("key", T.LongType()), T.StructField("subset", T.BooleanType()), T.StructField("side", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("pos", T.IntegerType())])


def _order(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """A set with the common shingles at its end."""
    if not len(common):
        return own
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    late = common[at] == own
    return np.concatenate([own[~late], own[late]])


def _entries(reps: DataFrame, light: int, common) -> DataFrame:
    def run(frames):
        shared = common.value
        for frame in frames:
            keys, subset, side, doc, pos = [], [], [], [], []
            for i, raw in zip(frame.column("doc_id").to_pylist(), frame.column("set").to_pylist(), strict=True):
                own = np.frombuffer(raw, "<u8")
                s = len(own)
                found, sides = [], []
                if s <= light:
                    for t in partners(s):
                        if t <= light:
                            tag = np.uint64(min(s, t) * 64 + max(s, t))
                            picks = np.array(list(combinations(range(s), least_overlap(s, t))))
                            found.append(W.mix((own[picks] * W.ORDER[: picks.shape[1]]).sum(axis=1, dtype=np.uint64) + tag))
                            sides.append(np.full(len(picks), 0 if s == t else 1 if s < t else 2))
                lists = np.zeros(0, np.uint64)
                if s > light or any(t > light for t in partners(s)):
                    lists = _order(own, shared)[: prefix_length(s)]
                subsets = np.concatenate([np.zeros(0, np.uint64), *found])
                keys += [subsets, lists]
                subset += [np.ones(len(subsets), bool), np.zeros(len(lists), bool)]
                doc.append(np.full(len(subsets) + len(lists), i))
                side += [*sides, np.zeros(len(lists), np.int64)]
                pos += [np.zeros(len(subsets), np.int64), np.arange(len(lists))]
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64), pa.int64()), pa.array(np.concatenate(subset)), pa.array(np.concatenate(side), pa.int32()), pa.array(np.concatenate(doc), pa.int64()), pa.array(np.concatenate(pos), pa.int32())], names=ENTRIES.names)

    return reps.select("doc_id", "set").mapInArrow(run, ENTRIES)


MAPS = 8
FACTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("shared", T.LongType()), *(T.StructField(f"m{k}", T.LongType()) for k in range(MAPS))])


def _facts(reps: DataFrame) -> DataFrame:
    """(doc_id, n, shared, m0, ...): of each set a map of 64 * MAPS bits, in which every shingle flips one bit.

    Two maps differ in at most as many bits as the sets differ in shingles.
    """

    def run(frames):
        for frame in frames:
            maps = np.zeros((frame.num_rows, MAPS), np.uint64)
            for k, raw in enumerate(frame.column("set").to_pylist()):
                bit = W.mix(np.frombuffer(raw, "<u8") + np.uint64(99)) >> np.uint64(64 - (64 * MAPS - 1).bit_length())
                odd = (np.bincount(bit.astype(np.int64), minlength=64 * MAPS) & 1).astype(np.uint8)
                maps[k] = np.packbits(odd, bitorder="little").view("<u8")
            yield pa.RecordBatch.from_arrays([frame.column("doc_id"), frame.column("n"), frame.column("shared"), *(pa.array(maps[:, k].copy().view(np.int64), pa.int64()) for k in range(MAPS))], names=FACTS.names)

    return reps.select("doc_id", "n", "shared", "set").mapInArrow(run, FACTS)


def _side(facts: DataFrame, p: str, *more: str) -> DataFrame:
    return facts.select(*(F.col(c).alias(f"{p}_{c}") for c in (*FACTS.names, *more)))


def _possible():
    """Whether sets x and y can link, by their sizes, shared counts and maps: never false for a pair that links."""
    total = F.col("x_n") + F.col("y_n")
    differ = sum((F.bit_count(F.col(f"x_m{k}").bitwiseXOR(F.col(f"y_m{k}"))) for k in range(1, MAPS)), F.bit_count(F.col("x_m0").bitwiseXOR(F.col("y_m0"))))
    return (5 * F.least("x_n", "y_n") >= 4 * F.greatest("x_n", "y_n")) & (9 * F.least("x_shared", "y_shared") >= 4 * total) & (9 * differ <= total)


PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _verified(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs that link, checked on whole sets."""
    left = reps.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a"))
    right = reps.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b"))

    def run(frames):
        for frame in frames:
            ok, last, a = [], None, None
            for x, y in zip(frame.column("set_a"), frame.column("set_b"), strict=True):
                x = x.as_py()
                if x != last:
                    last, a = x, np.frombuffer(x, "<u8")
                b = np.frombuffer(y.as_py(), "<u8")
                at = np.searchsorted(a, b)
                overlap = int((a[np.minimum(at, len(a) - 1)] == b).sum()) if len(a) else 0
                ok.append(9 * overlap >= 4 * (len(a) + len(b)))
            yield frame.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, PAIRS)


def _linked(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of the classes that link."""
    spark = reps.sparkSession
    counted = reps.agg(F.count("*")).first()[0]
    sizes = {r["n"]: r["count"] for r in reps.where(F.col("n") <= 2 * LIGHT_MOST).groupBy("n").count().collect()}  # 2 * LIGHT_MOST rows at most
    light = light_size(sizes)

    most = max(32, int(counted * RARE))  # so at most a set's mean size / RARE shingles are common
    buckets = partitions(spark)

    def runs(frames):
        own = C.Run(1, buckets)
        for frame in frames:
            for raw in frame.column("set").to_pylist():
                yield from own.add(np.frombuffer(raw, "<u8"))
        yield from own.flush()

    def frequent(kind, bucket, keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(keys[counts > most].view(np.int64), pa.int64())], names=["key"])

    found = C.reduced(reps.select("set").mapInArrow(runs, C.PACKED), T.StructType([T.StructField("key", T.LongType())]), frequent)
    common = np.sort(np.array([r["key"] for r in found.toLocalIterator()], np.int64).view(np.uint64))
    facts = scratch.save(_facts(reps), "facts")
    entries = scratch.save(_entries(reps, light, spark.sparkContext.broadcast(common)), "entries")
    # a subset of sizes s and t joins sets of s with sets of t: each side meets the other's least
    pivots = entries.groupBy("key", "subset").agg(F.min(F.when(F.col("side") < 2, F.col("doc_id"))).alias("low"), F.min(F.when(F.col("side") == 2, F.col("doc_id"))).alias("high"), F.count("*").alias("c")).where("c > 1").drop("c")
    met = entries.join(pivots, ["key", "subset"]).withColumn("a", F.when(F.col("side") == 1, F.col("high")).otherwise(F.col("low"))).where("doc_id <> a")
    stars = scratch.save(met.groupBy("a", F.col("doc_id").alias("b")).agg(F.max("subset").alias("subset")), "stars")
    able = stars.where("not subset").join(_side(facts, "x"), F.col("a") == F.col("x_doc_id")).join(_side(facts, "y"), F.col("b") == F.col("y_doc_id")).where(_possible())
    first = scratch.save(stars.where("subset").select("a", "b").union(_verified(able.select("a", "b"), reps)), "links")
    members = scratch.save(graph.components(first, scratch), "components")
    # lists that still hold several components, with what may rule a link out
    known = facts.join(members.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    known = scratch.save(known, "known")
    placed = scratch.save(entries.where("not subset").select("key", "doc_id", "pos").join(known.select("doc_id", "component"), "doc_id"), "placed")
    split = placed.groupBy("key", "component").agg(F.count("*").alias("c"))
    major = split.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("major"), F.count("*").alias("parts")).where("parts > 1").select("key", "major")
    mixed = scratch.save(placed.join(major, "key"), "mixed")
    full = mixed.drop("component").join(known, "doc_id")
    x = full.where("component <> major").select("key", *(F.col(c).alias(f"x_{c}") for c in (*FACTS.names, "component", "pos")))
    y = full.select("key", *(F.col(c).alias(f"y_{c}") for c in (*FACTS.names, "component", "pos")))
    # a pair that links also meets in the shorter prefixes of its own overlap: from there on enough shingles are left
    total = F.col("x_n") + F.col("y_n")
    early = (9 * (F.col("x_n") - F.col("x_pos")) >= 4 * total) & (9 * (F.col("y_n") - F.col("y_pos")) >= 4 * total)
    met = x.join(y, (x["key"] == y["key"]) & (F.col("x_component") != F.col("y_component")) & early & _possible())
    pairs = met.select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b")).distinct()
    second = scratch.save(_verified(scratch.save(pairs, "pairs"), reps), "more-links")
    if second.isEmpty():
        return members
    # components are stars already
    joined = members.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).union(second)
    return scratch.save(graph.components(joined, scratch), "components")


def groups(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document row: the smallest doc_id that links reach."""
    scratch = Scratch(docs.sparkSession)
    narrow = docs.select("doc_id", "text")
    counted = _shared(narrow, _texts(n), scratch)
    may = counted.where("doc_id is not null and n > 0 and 5 * shared >= 4 * n")
    classes = scratch.save(may.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    wanted = may.join(classes, (may["doc_id"] == classes["rep"]) & (may["digest"] == classes["digest"])).select("doc_id", "n").distinct()
    reps = _sets(narrow.join(wanted.select("doc_id").distinct().hint("shuffle_hash"), "doc_id"), n)
    reps = scratch.save(reps.join(wanted, ["doc_id", "n"], "left_semi").dropDuplicates(["doc_id", "n"]), "sets")
    still = _shared(reps, _packed, scratch).where("5 * shared >= 4 * n").select("doc_id", "shared")
    linkable = scratch.save(reps.join(still, "doc_id"), "linkable")
    scratch.drop(reps)
    linked = _linked(linkable, scratch)
    own = may.select("doc_id", "digest").join(classes, "digest").join(linked, F.col("rep") == linked["node"], "left")
    own = own.groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    found = counted.select("doc_id", F.col("n").alias("n_shingles")).join(own, "doc_id", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = N) -> DataFrame:
    """docs, in their own columns, with one row of each component: that of the least doc_id (null after all others).

    Rows without words link with nothing, so all of them stay. Where doc_ids repeat or are null, rows get keys of their own first.
    """
    row = "_ngramjoin_row"
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        gone = groups(docs, n).where("component_id <> doc_id").select(F.col("doc_id").alias(row))
        return docs.join(gone, docs["doc_id"] == gone[row], "left_anti")
    scratch = Scratch(docs.sparkSession)
    keyed = scratch.save(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    found = groups(keyed.select(F.col(row).alias("doc_id"), "text"), n).select(F.col("doc_id").alias(row), "component_id")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row))
    least = scratch.save(found.join(keyed.select(row, "doc_id"), row).groupBy("component_id").agg(F.min(order)[row].alias(row)), "least")
    return keyed.join(least.select(row), row, "left_semi").select(*docs.columns)
