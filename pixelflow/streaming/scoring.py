"""Streaming quality scores: pixel pairs arrive, every image's metrics are kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color


def running_metrics(pairs: DataFrame) -> DataFrame:
    """A streaming aggregation of (image_id, y, x, r, g, b, dr, dg, db) to (image_id, pixels, mse, max_error, psnr)."""
    square = sum(((F.col(c) - F.col(f"d{c}")) * (F.col(c) - F.col(f"d{c}")) for c in "gb"), (F.col("r") - F.col("dr")) * (F.col("r") - F.col("dr")))
    worst = F.greatest(*(F.abs(F.col(c) - F.col(f"d{c}")) for c in "rgb"))
    sums = pairs.groupBy("image_id").agg(F.count("*").alias("pixels"), F.sum(square).alias("s"), F.max(worst).alias("max_error"))
    return sums.withColumn("mse", F.col("s") / (F.col("pixels") * 3)).withColumn("psnr", color.psnr(F.col("mse"))).drop("s")
