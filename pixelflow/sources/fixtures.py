"""Pixel relations derived from the driver tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 100
BANDS = 24


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, pid, y, x, r, g, b), one image of blocks with small noise, WIDTH wide."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value", "user_id")
    p = e.selectExpr("event_id as pid", f"cast(floor(event_id / {WIDTH}) as bigint) as y", f"event_id % {WIDTH} as x", "cast(floor(value) as bigint) as v", "user_id as u")
    p = p.withColumn("blk", F.expr("cast(floor(y / 10) as bigint) * 10 + cast(floor(x / 10) as bigint)"))
    return p.selectExpr("cast(0 as bigint) as image_id", "pid", "y", "x", "(blk * 73 + 41) % 200 + v % 16 as r", "(blk * 151 + 7) % 200 + u % 16 as g", "(blk * 29 + 90) % 200 + (v + u) % 16 as b")


def coarse(pixels: DataFrame) -> DataFrame:
    """Channels quantized to multiples of 16."""
    return pixels.withColumns({c: F.expr(f"cast(floor({c} / 16) as bigint) * 16") for c in "rgb"})


def decoded(pixels: DataFrame) -> DataFrame:
    """(image_id, pid, y, x, dr, dg, db), the image after quantization to bucket centres."""
    return pixels.selectExpr("image_id", "pid", "y", "x", *(f"cast(floor({c} / 16) as bigint) * 16 + 8 as d{c}" for c in "rgb"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the mosaic cut into up to BANDS images along y; y counts from each image's top."""
    p = mosaic(spark, sf_dir)
    top = p.agg((F.max("y") + 1).alias("h"))
    p = p.crossJoin(F.broadcast(top)).withColumn("image_id", F.expr(f"cast(floor(y * {BANDS} / h) as bigint)")).drop("h")
    first = p.groupBy("image_id").agg(F.min("y").alias("y0"))
    return p.join(first, "image_id").withColumn("y", F.col("y") - F.col("y0")).drop("y0")


def white(pixels: DataFrame, threshold: int = 100) -> DataFrame:
    """(image_id, pid, y, x, v), v 255 where r is over the threshold."""
    return pixels.selectExpr("image_id", "pid", "y", "x", f"cast(case when r > {threshold} then 255 else 0 end as bigint) as v")


def blackened(pixels: DataFrame) -> DataFrame:
    """every sixteenth pixel black."""
    return pixels.withColumns({c: F.expr(f"case when pid % 16 = 0 then cast(0 as bigint) else {c} end") for c in "rgb"})


def rectangles(pixels: DataFrame) -> DataFrame:
    """(image_id, comp_ord, y, x, r, g, b), three overlapping rectangles that cover most of an image, colours shifted by their order."""
    spots = pixels.sparkSession.createDataFrame([(0, 0, 6, 0, 60), (1, 3, 9, 30, 90), (2, 2, 8, 10, 80)], "comp_ord long, y0 long, y1 long, x0 long, x1 long")
    high = pixels.groupBy("image_id").agg((F.max("y") + 1).alias("h"))
    cut = coarse(blackened(pixels)).join(high, "image_id").join(F.broadcast(spots), F.expr("y * 10 >= y0 * h and y * 10 < y1 * h and x >= x0 and x < x1"))
    return cut.selectExpr("image_id", "comp_ord", "y", "x", *(f"case when r + g + b = 0 then 0 else {c} + comp_ord end as {c}" for c in "rgb"))


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, value) of the embeddings."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.lit(0).cast("long").alias("image_id"), F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "value")).selectExpr("image_id", "y", "cast(x as bigint) as x", "cast(value as double) as value")


def polyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(shape_id, seq, px, py), a shape for every 1,000 events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.selectExpr("cast(floor(event_id / 1000) as bigint) as shape_id", "event_id % 1000 as seq", "cast(event_id % 97 as double) / 2 as px", "cast(user_id as double) / 2 as py")
