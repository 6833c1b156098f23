"""Contrast-limited histogram equalization of shadows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color
from ..functions.durable import durable

KEY = ["image_id", "y", "x"]


def clahe_column(values: np.ndarray, tiles: int = 16, clip: float = 3.0) -> np.ndarray:
    """Equalizes a run of 8-bit values in `tiles` stretches; between the stretches' middles, mappings are interpolated."""
    n = len(values)
    if not n:
        return values
    tiles = max(1, min(tiles, n))
    size = -(-n // tiles)
    tiles = -(-n // size)
    maps = np.zeros((tiles, 256))
    for t in range(tiles):
        own = values[t * size : (t + 1) * size]
        h = np.bincount(own, minlength=256).astype(float)
        limit = max(1.0, clip * len(own) / 256)
        extra = np.maximum(h - limit, 0).sum()
        h = np.minimum(h, limit) + extra / 256
        maps[t] = np.round(np.cumsum(h) * 255 / len(own))
    at = (np.arange(n) - (size - 1) / 2) / size
    low = np.clip(np.floor(at).astype(int), 0, tiles - 1)
    high = np.clip(low + 1, 0, tiles - 1)
    share = np.clip(at - low, 0, 1)
    return np.clip(np.round(maps[low, values] * (1 - share) + maps[high, values] * share), 0, 255).astype(np.int64)


def shadows(light: DataFrame, threshold: int = 100, clip: float = 3.0, tiles: int = 16, least: int | None = None) -> DataFrame:
    """(image_id, y, x, v): values under the threshold, in raster order, equalized; the rest as it is. `least` lifts the result."""

    def run(key, table):
        y, x, v = (table.column(c).to_numpy() for c in ("y", "x", "v"))
        order = np.lexsort((x, y))
        dark = order[v[order] < threshold]
        out = v.copy()
        out[dark] = clahe_column(v[dark], tiles, clip)
        if least is not None:
            out[dark] = np.maximum(out[dark], least)
        return table.set_column(table.schema.get_field_index("v"), "v", pa.array(out))

    return light.select(*KEY, "v").groupBy("image_id").applyInArrow(run, "image_id long, y long, x long, v long")


def shadow_regions(light: DataFrame, threshold: int = 100, clip: float = 3.0, least_area: int = 10) -> DataFrame:
    """The same for each connected shadow of more than least_area pixels on its own."""
    from . import components as cc

    labels = cc.label(light.where(F.col("v") < threshold))
    big = labels.join(cc.stats(labels).where(F.col("area") > least_area), ["image_id", "label"], "left_semi").join(light, KEY)

    def run(key, table):
        y, x, v = (table.column(c).to_numpy() for c in ("y", "x", "v"))
        order = np.lexsort((x, y))
        out = v.copy()
        out[order] = clahe_column(v[order], 1, clip)
        return pa.table([table.column("image_id"), table.column("y"), table.column("x"), pa.array(out)], names=["image_id", "y", "x", "w"])

    done = big.select("image_id", "label", "y", "x", "v").groupBy("image_id", "label").applyInArrow(run, "image_id long, y long, x long, w long")
    return light.select(*KEY, "v").join(done, KEY, "left").select(*KEY, F.coalesce("w", "v").alias("v"))


def images(pixels: DataFrame, threshold: int = 100, clip: float = 3.0, tiles: int = 16, least: int | None = None, by_region: bool = False) -> DataFrame:
    """(image_id, y, x, r, g, b): colour images whose shadows are equalized in 8-bit L of L*a*b*, a and b kept; pixels that
    don't change keep their colour. by_region: each connected shadow on its own."""
    l_, a_, b_ = color.lab8()
    known = pixels.select(*KEY, *"rgb", l_.alias("l"), a_.alias("a"), b_.alias("bb")).transform(durable)
    light = known.select(*KEY, F.col("l").alias("v"))
    done = shadow_regions(light, threshold, clip) if by_region else shadows(light, threshold, clip, tiles, least)
    met = known.join(done.select(*KEY, F.col("v").alias("w")), KEY)
    fresh = color.from_lab8("w", "a", "bb")
    return met.select(*KEY, *(F.when(F.col("w") == F.col("l"), F.col(c)).otherwise(new).alias(c) for c, new in zip("rgb", fresh, strict=True)))


def brightness_gain(before: DataFrame, after: DataFrame) -> DataFrame:
    """(image_id, before, after, gain): mean values."""
    a, b = (df.groupBy("image_id").agg(F.avg("v").alias(n)) for df, n in ((before, "before"), (after, "after")))
    return a.join(b, "image_id").withColumn("gain", F.col("after") - F.col("before"))
