"""Index packing: dtypes, run-length codes, DEFLATE, and the component container."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import color

MAGIC = b"PXF1\x00"
TYPES = {"uint8": "<u1", "uint16": "<u2", "uint32": "<u4"}
MAX_RUN = 65535


def dtype(index: DataFrame) -> DataFrame:
    """(image_id, top, dtype): the narrowest type of every image's indices."""
    return index.groupBy("image_id").agg(F.max("idx").alias("top")).withColumn("dtype", color.index_dtype(F.col("top")))


def size_estimate(palette: DataFrame, index: DataFrame, header: int = 50) -> DataFrame:
    """(image_id, n_colors, pixels, original_size, compressed_size, ratio): 3 bytes a colour, 1 or 2 a pixel, a header."""
    n = palette.groupBy("image_id").agg(F.count("*").alias("n_colors"))
    px = index.groupBy("image_id").agg(F.count("*").alias("pixels"))
    both = n.join(px, "image_id").withColumn("original_size", F.col("pixels") * 3)
    both = both.withColumn("compressed_size", F.col("n_colors") * 3 + F.col("pixels") * F.when(F.col("n_colors") <= 256, 1).otherwise(2) + header)
    return both.withColumn("ratio", F.col("original_size") / F.col("compressed_size"))


def runs(index: DataFrame, line: list[str] = ("image_id", "y"), at: str = "x", longest: int = MAX_RUN) -> DataFrame:
    """(line..., start, idx, n): runs of equal indices along each line, none longer than `longest`.

    Lines are rows of an image, so that no task needs a whole one.
    """
    w = Window.partitionBy(*line).orderBy(at)
    new = F.when((F.lag("idx").over(w) == F.col("idx")) & (F.lag(at).over(w) == F.col(at) - 1), 0).otherwise(1)
    numbered = index.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    inside = Window.partitionBy(*line, "_run").orderBy(at)
    cut = numbered.withColumn("_cut", F.floor((F.row_number().over(inside) - 1) / longest))
    return cut.groupBy(*line, "_run", "_cut").agg(F.min(at).alias("start"), F.first("idx").alias("idx"), F.count("*").alias("n")).drop("_run", "_cut")


def expand(coded: DataFrame, at: str = "x") -> DataFrame:
    """The indices that runs stand for."""
    return coded.select(*(c for c in coded.columns if c not in ("start", "n")), F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias(at))


def pack(height: int, width: int, palette: np.ndarray, index: np.ndarray, kind: str, method: str = "deflate") -> bytes:
    """magic | height, width, colours u32 | dtype, method u8 | lengths u32 | palette | indices."""
    colours = zlib.compress(palette.astype(np.uint8).tobytes(), 9)
    if method == "rle":
        cut = np.flatnonzero(np.append(True, index[1:] != index[:-1])) if len(index) else np.zeros(0, np.int64)
        n = np.diff(np.append(cut, len(index)))
        again = -(-n // MAX_RUN)
        value = np.repeat(index[cut], again).astype("<u4")
        length = np.full(len(value), MAX_RUN, "<u2")
        if len(value):
            length[np.cumsum(again) - 1] = n - (again - 1) * MAX_RUN
        body = zlib.compress(value.tobytes() + length.tobytes(), 9)
    else:
        body = zlib.compress(index.astype(TYPES[kind]).tobytes(), 9)
    head = struct.pack("<IIIBBII", height, width, len(palette), list(TYPES).index(kind), int(method == "rle"), len(colours), len(body))
    return MAGIC + head + colours + body


def unpack(raw: bytes) -> tuple[int, int, np.ndarray, np.ndarray, str]:
    """Height, width, palette, indices, dtype; ValueError for other bytes."""
    if raw[: len(MAGIC)] != MAGIC:
        raise ValueError("not a component container")
    at = len(MAGIC) + struct.calcsize("<IIIBBII")
    height, width, n, kind, rle, a, b = struct.unpack("<IIIBBII", raw[len(MAGIC) : at])
    kind = list(TYPES)[kind]
    palette = np.frombuffer(zlib.decompress(raw[at : at + a]), np.uint8).reshape(n, 3)
    body = zlib.decompress(raw[at + a : at + a + b])
    if rle:
        many = len(body) // 6
        index = np.repeat(np.frombuffer(body, "<u4", many), np.frombuffer(body, "<u2", many, many * 4))
    else:
        index = np.frombuffer(body, TYPES[kind])
    return height, width, palette, index.astype(np.int64), kind


CONTAINER = T.StructType([T.StructField("image_id", T.LongType()), T.StructField("height", T.LongType()), T.StructField("width", T.LongType()), T.StructField("n_colors", T.LongType()), T.StructField("dtype", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("data", T.BinaryType())])


def containers(index: DataFrame, palette: DataFrame, method: str = "deflate") -> DataFrame:
    """One packed container for every image, with its figures; an image is one task's."""

    def run(key, left, right):
        y, x, idx = (left.column(c).to_numpy() for c in ("y", "x", "idx"))
        order = np.lexsort((x, y))
        order_p = np.argsort(right.column("idx").to_numpy())
        colours = np.column_stack([right.column(c).to_numpy()[order_p] for c in "rgb"]) if right.num_rows else np.zeros((0, 3))
        h, w = (int(y.max()) + 1, int(x.max()) + 1) if len(y) else (0, 0)
        top = int(idx.max()) if len(idx) else 0
        kind = "uint8" if top < 256 else "uint16" if top < 65536 else "uint32"
        raw = pack(h, w, colours, idx[order], kind, method)
        return pa.table([[key[0].as_py()], [h], [w], [len(colours)], [kind], [len(raw)], pa.array([raw], pa.binary())], names=CONTAINER.names)

    fresh = lambda df, *names: df.select(*(F.col(c).alias(c) for c in names))  # noqa: E731  the indices may come from the same palette
    index, palette = fresh(index, "image_id", "y", "x", "idx"), fresh(palette, "image_id", "idx", "r", "g", "b")
    return index.groupBy("image_id").cogroup(palette.groupBy("image_id")).applyInArrow(run, CONTAINER)


PIXELS = T.StructType([T.StructField("image_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("y", "x", "r", "g", "b"))])


def pixels(packed: DataFrame) -> DataFrame:
    """The decoded pixels of packed containers (image_id, data)."""

    def run(frames):
        for frame in frames:
            for image, raw in zip(frame.column("image_id").to_pylist(), frame.column("data").to_pylist(), strict=True):
                h, w, palette, index, _ = unpack(raw)
                pos = np.arange(len(index))
                rgb = palette[index].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pos), image)), pa.array(pos // max(1, w)), pa.array(pos % max(1, w)), *(pa.array(rgb[:, k].copy()) for k in range(3))], names=PIXELS.names)

    return packed.select("image_id", "data").mapInArrow(run, PIXELS)
