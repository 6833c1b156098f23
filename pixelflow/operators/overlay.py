"""Priority merge of segments onto a canvas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RGB = ["r", "g", "b"]


def first_wins(components: DataFrame) -> DataFrame:
    """(image_id, y, x, comp_ord, r, g, b): of the non-black pixels placed on a spot that of the least comp_ord."""
    placed = components.where("r + g + b > 0")
    return placed.groupBy("image_id", "y", "x").agg(F.min("comp_ord").alias("comp_ord"), F.min_by(F.struct(*RGB), "comp_ord").alias("c")).select("image_id", "y", "x", "comp_ord", *(F.col(f"c.{c}") for c in RGB))


def canvas(merged: DataFrame, height: int, width: int) -> DataFrame:
    """The whole canvas; spots that nothing covers are black."""
    spots = merged.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(height - 1).cast("long"))).alias("y")).select("image_id", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias("x"))
    return spots.join(merged, ["image_id", "y", "x"], "left").select("image_id", "y", "x", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in RGB))


def palette_order(components: DataFrame) -> DataFrame:
    """(image_id, idx, r, g, b): black at 0, then colours as they are first placed: last component first, raster order
    inside; colours that are overwritten later keep their place."""
    seen = components.where("r + g + b > 0").groupBy("image_id", *RGB).agg(F.min(F.struct(-F.col("comp_ord"), "y", "x")).alias("at"))
    numbered = seen.select("image_id", F.row_number().over(Window.partitionBy("image_id").orderBy("at")).cast("long").alias("idx"), *RGB)
    zero = F.lit(0).cast("long")
    return numbered.unionByName(components.select("image_id").distinct().select("image_id", zero.alias("idx"), *(zero.alias(c) for c in RGB)))
