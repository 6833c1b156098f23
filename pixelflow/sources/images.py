"""Image, container, point and metrics sources and sinks. Every reader and writer goes through Spark."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codec


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, origin, y, x, r, g, b) of image files; image_id numbers their paths by hash. Undecodable files are left out."""
    files = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def run(frames):
        for frame in frames:
            for origin, h, w, n, data in zip(*(frame.column(c).to_pylist() for c in ("origin", "height", "width", "nChannels", "data")), strict=True):
                px = np.frombuffer(data, np.uint8).reshape(h * w, n).astype(np.int64)
                bgr = px[:, :3] if n >= 3 else np.repeat(px[:, :1], 3, axis=1)
                pos = np.arange(h * w)
                yield pa.RecordBatch.from_arrays([pa.array([origin] * len(pos)), pa.array(pos // w), pa.array(pos % w), *(pa.array(bgr[:, k].copy()) for k in (2, 1, 0))], names=["origin", "y", "x", "r", "g", "b"])

    rows = files.mapInArrow(run, "origin string, y long, x long, r long, g long, b long")
    return rows.select(F.xxhash64("origin").alias("image_id"), "*")


def resized(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Nearest-neighbour resize: every target place gathers one source pixel."""
    size = pixels.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    rows = size.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(height - 1).cast("long"))).alias("ty")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias("tx"))
    at = rows.select("image_id", "ty", "tx", F.floor(F.col("ty") * F.col("h") / height).alias("y"), F.floor(F.col("tx") * F.col("w") / width).alias("x"))
    return at.join(pixels, ["image_id", "y", "x"]).drop("y", "x").withColumnsRenamed({"ty": "y", "tx": "x"})


def write_containers(index: DataFrame, palette: DataFrame, path: str) -> None:
    """Packed containers as a table, written by Spark's committing writer."""
    codec.containers(index, palette).write.mode("overwrite").parquet(path)


def read_containers(spark: SparkSession, path: str) -> DataFrame:
    """Decoded pixels of a container table."""
    return codec.pixels(spark.read.parquet(path))


def read_container_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Decoded pixels of binary container files, and (path, length) of files that are none."""
    files = spark.read.format("binaryFile").load(path)
    good = F.substring("content", 1, len(codec.MAGIC)) == F.lit(bytearray(codec.MAGIC))
    return codec.pixels(files.where(good).select(F.xxhash64("path").alias("image_id"), F.col("content").alias("data"))), files.where(~good).select("path", "length")


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, kilobytes) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", (F.col("length") / 1024).alias("kilobytes"))


def write_points(points: DataFrame, path: str, decimals: int = 3) -> None:
    """Points as CSV with a fixed number of decimals."""
    text = {c: F.format_number(c, decimals) for c, t in points.dtypes if t == "double"}
    points.withColumns({c: F.replace(v, F.lit(",")) for c, v in text.items()}).write.mode("overwrite").option("header", True).csv(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("shape_id long, seq long, px double, py double").csv(path)


def write_npy(matrix: DataFrame, path: str) -> None:
    """(name, data) of each `name` of (name, row, column, value), data its .npy bytes in doubles, missing cells 0; a matrix is one task's."""

    def run(key, table):
        i, j, v = (table.column(c).to_numpy() for c in ("row", "column", "value"))
        m = np.zeros((int(i.max()) + 1, int(j.max()) + 1))
        m[i, j] = v
        out = io.BytesIO()
        np.save(out, m, allow_pickle=False)
        return pa.table([pa.array([key[0].as_py()]), pa.array([out.getvalue()], pa.binary())], names=["name", "data"])

    matrix.select("name", "row", "column", "value").groupBy("name").applyInArrow(run, "name string, data binary").write.mode("overwrite").parquet(path)


def read_npy_table(spark: SparkSession, path: str) -> DataFrame:
    """(name, row, column, value) of what `write_npy` has written."""

    def run(frames):
        for frame in frames:
            for name, raw in zip(frame.column("name").to_pylist(), frame.column("data").to_pylist(), strict=True):
                m = np.load(io.BytesIO(raw), allow_pickle=False)
                i, j = np.indices(m.shape)
                yield pa.RecordBatch.from_arrays([pa.array([name] * m.size), pa.array(i.ravel()), pa.array(j.ravel()), pa.array(m.ravel())], names=["name", "row", "column", "value"])

    return spark.read.parquet(path).mapInArrow(run, "name string, row long, column long, value double")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, column, value) of two-dimensional .npy files."""

    def run(frames):
        for frame in frames:
            for name, raw in zip(frame.column("path").to_pylist(), frame.column("content").to_pylist(), strict=True):
                m = np.atleast_2d(np.load(io.BytesIO(raw), allow_pickle=False)).astype(float)
                i, j = np.indices(m.shape)
                yield pa.RecordBatch.from_arrays([pa.array([name] * m.size), pa.array(i.ravel()), pa.array(j.ravel()), pa.array(m.ravel())], names=["path", "row", "column", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, row long, column long, value double")


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").option("header", True).csv(path)
