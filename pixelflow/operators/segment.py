"""Sub-region scoring and segmentation: texture and colour scores, superpixels, watershed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color
from . import grid
from .grid import along_x, along_y, reflected

KEY = ["image_id", "y", "x"]
TONE = ["tone_l", "tone_a", "tone_b"]


def lbp(gray: DataFrame) -> DataFrame:
    """(image_id, y, x, code): one bit for each of the 8 neighbours that is at least as bright; borders mirrored."""
    rows = gray.select(*KEY, "v").withColumns({"l": reflected("v", -1, along_x()), "r": reflected("v", 1, along_x())})
    up, down = (lambda c: reflected(c, -1, along_y())), (lambda c: reflected(c, 1, along_y()))
    rows = rows.withColumns({"u": up("v"), "ul": up("l"), "ur": up("r"), "d": down("v"), "dl": down("l"), "dr": down("r")})
    code = F.lit(0)
    for bit, c in enumerate(("r", "dr", "d", "dl", "l", "ul", "u", "ur")):
        code = code + F.when(F.col(c) >= F.col("v"), 1 << bit).otherwise(0)
    return rows.select(*KEY, code.cast("long").alias("code"))


def lbp_histogram(gray: DataFrame) -> DataFrame:
    """(image_id, bits, n): pixels by the number of set bits."""
    return lbp(gray).groupBy("image_id", F.bit_count("code").cast("long").alias("bits")).agg(F.count("*").alias("n"))


def entropy(gray: DataFrame, bins: int = 32) -> DataFrame:
    """(image_id, entropy) in bits of a `bins`-bin histogram of 8-bit values."""
    h = gray.groupBy("image_id", F.floor(F.col("v") * bins / 256).alias("bin")).agg(F.count("*").alias("n"))
    total = gray.groupBy("image_id").agg(F.count("*").alias("t"))
    p = F.col("n") / F.col("t")
    return h.join(total, "image_id").groupBy("image_id").agg((-F.sum(p * F.log2(p))).alias("entropy"))


def scores(pixels: DataFrame, inside: str | None = None) -> DataFrame:
    """(image_id, size, color_score, texture_score, overall): .4 colour and .6 texture; 0 under 100 pixels.

    inside: a boolean column, if only those pixels count; the others are neighbours still.

    Colour: .7 of the mean deviation of L, a, b over their ranges and .3 of the mean gradient of gray over 3. Texture: mean of
    the LBP entropy over 3, 50 times the Sobel variance, the gray entropy over 5 and twice gray's deviation, each clipped to 0..1.
    """
    l_, a_, b_ = color.lab()
    known = pixels.withColumns({"L": l_, "A": a_, "B": b_, "gf": color.gray_float(), "v": color.gray()})
    g = grid.sobel(known.select(*KEY, "gf"), "gf").select(*KEY, (F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2) / 8).alias("m"))
    codes = lbp(known)
    if inside is not None:
        own = known.where(inside).select(*KEY)
        codes, known = codes.join(own, KEY, "left_semi"), known.where(inside)
    s = known.join(g, KEY).groupBy("image_id").agg(F.count("*").alias("size"), *(F.stddev_pop(c).alias(f"d{c}") for c in "LAB"), F.avg("m").alias("gm"), F.var_pop("m").alias("gv"), F.stddev_pop("gf").alias("gd"))
    bits = codes.groupBy("image_id", F.bit_count("code").cast("long").alias("bits")).agg(F.count("*").alias("n")).join(known.groupBy("image_id").agg(F.count("*").alias("t")), "image_id")
    p = F.col("n") / F.col("t")
    le = bits.groupBy("image_id").agg((-F.sum(p * F.log2(p))).alias("le"))
    s = s.join(le, "image_id").join(entropy(known), "image_id")
    one = lambda c: color.clip(c, 0.0, 1.0)
    col = one((F.col("dL") / 100 + F.col("dA") / 128 + F.col("dB") / 128) / 3 * 0.7 + F.col("gm") / 3 * 0.3)
    tex = (one(F.col("le") / 3) + one(F.col("gv") * 50) + one(F.col("entropy") / 5) + one(F.col("gd") * 2)) / 4
    small = F.col("size") < 100
    s = s.withColumns({"color_score": F.when(small, 0.0).otherwise(col), "texture_score": F.when(small, 0.0).otherwise(tex)})
    return s.select("image_id", "size", "color_score", "texture_score", (F.col("color_score") * 0.4 + F.col("texture_score") * 0.6).alias("overall"))


def segments_wanted(scored: DataFrame) -> DataFrame:
    """scored with `window` and `segments`."""
    window = color.split_window(F.col("size") * 3)
    return scored.withColumn("window", window).withColumn("segments", color.sigmoid_segments(F.col("overall"), F.col("window")).cast("long"))


def slic_labels(y: np.ndarray, x: np.ndarray, rgb: np.ndarray, segments: int, compactness: float = 10.0, rounds: int = 10) -> np.ndarray:
    """Superpixel labels from 1: k-means in colour (three columns) and place around a regular grid of seeds, each in its window."""
    top, left = y.min(), x.min()
    h, w = int(y.max() - top) + 1, int(x.max() - left) + 1
    step = max(1.0, (len(y) / max(1, segments)) ** 0.5)
    cell = ((y - top) // step).astype(np.int64) * (int(w // step) + 1) + ((x - left) // step).astype(np.int64)
    _, label = np.unique(cell, return_inverse=True)
    place = np.column_stack([y, x]).astype(float)
    k = int(label.max()) + 1
    at = np.full((h, w), -1, np.int64)
    at[y - top, x - left] = np.arange(len(y))
    for _ in range(rounds):
        n = np.maximum(np.bincount(label, minlength=k), 1)[:, None]
        centre = np.column_stack([np.bincount(label, weights=place[:, i], minlength=k) for i in range(2)]) / n
        tone = np.column_stack([np.bincount(label, weights=rgb[:, i], minlength=k) for i in range(3)]) / n
        best = np.full(len(y), np.inf)
        after = label.copy()
        for c in range(k):
            a, b = int(max(0, centre[c, 0] - top - 2 * step)), int(max(0, centre[c, 1] - left - 2 * step))
            own = at[a : int(centre[c, 0] - top + 2 * step) + 1, b : int(centre[c, 1] - left + 2 * step) + 1].ravel()
            own = own[own >= 0]
            d = ((rgb[own] - tone[c]) ** 2).sum(axis=1) + ((place[own] - centre[c]) ** 2).sum(axis=1) * (compactness / step) ** 2
            near = d < best[own]
            best[own[near]], after[own[near]] = d[near], c
        if np.array_equal(after, label):
            break
        label = after
    return np.unique(label, return_inverse=True)[1] + 1


def slic(pixels: DataFrame, wanted: DataFrame) -> DataFrame:
    """(image_id, y, x, r, g, b, segment) of every pixel, clustered in L*a*b*; a region (here an image) is one task's."""

    def run(key, table):
        y, x = (table.column(c).to_numpy() for c in ("y", "x"))
        tone = np.column_stack([table.column(c).to_numpy() for c in TONE])
        label = slic_labels(y, x, tone, table.column("segments")[0].as_py())
        return table.drop_columns(["segments", *TONE]).append_column("segment", pa.array(label.astype(np.int64)))

    kept = pixels.select(*KEY, "r", "g", "b", *(c.alias(n) for c, n in zip(color.lab(), TONE, strict=True))).join(wanted.select("image_id", "segments"), "image_id")
    return kept.groupBy("image_id").applyInArrow(run, "image_id long, y long, x long, r long, g long, b long, segment long")


def boundaries(labels: DataFrame, segment: str = "segment") -> DataFrame:
    """(image_id, segment, area, num_points, boundary): border pixels in raster order; segments of under 2 rows or columns
    have a 4-point square."""
    sides = labels.sparkSession.createDataFrame([(0, 1), (1, 0), (0, -1), (-1, 0)], "dy long, dx long")
    near = labels.select(*KEY, segment).crossJoin(F.broadcast(sides)).select("image_id", segment, (F.col("y") + F.col("dy")).alias("ny"), (F.col("x") + F.col("dx")).alias("nx"), "y", "x")
    other = labels.select("image_id", F.col("y").alias("ny"), F.col("x").alias("nx"), segment)
    edge = near.join(other, ["image_id", "ny", "nx", segment], "left_anti").select("image_id", segment, "y", "x").distinct()
    points = edge.groupBy("image_id", segment).agg(F.sort_array(F.collect_list(F.struct(F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")))).alias("boundary"))
    s = labels.groupBy("image_id", segment).agg(F.count("*").alias("area"), F.min("y").alias("t"), F.max("y").alias("b"), F.min("x").alias("l"), F.max("x").alias("r"))
    corner = lambda y, x: F.struct(F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"))
    square = F.array(corner("t", "l"), corner("t", "r"), corner("b", "r"), corner("b", "l"))
    met = s.join(points, ["image_id", segment]).withColumn("boundary", F.when((F.col("t") == F.col("b")) | (F.col("l") == F.col("r")), square).otherwise(F.col("boundary")))
    return met.select("image_id", segment, "area", F.size("boundary").cast("long").alias("num_points"), "boundary")


def watershed_labels(height: np.ndarray, seeds: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Floods a surface from numbered seeds inside a mask, lowest first."""
    import heapq

    label = np.where(mask, seeds, 0)
    heap = [(float(height[y, x]), i, int(y), int(x)) for i, (y, x) in enumerate(zip(*np.nonzero(label), strict=True))]
    heapq.heapify(heap)
    count = len(heap)
    while heap:
        _, _, y, x = heapq.heappop(heap)
        for ny, nx in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 <= ny < label.shape[0] and 0 <= nx < label.shape[1] and mask[ny, nx] and not label[ny, nx]:
                label[ny, nx] = label[y, x]
                heapq.heappush(heap, (float(height[ny, nx]), count, ny, nx))
                count += 1
    return label


def watershed(binary: DataFrame, segments: int = 16) -> DataFrame:
    """(image_id, y, x, segment): the highest peaks of the distance to black, flooded; one task for each image."""
    from .roi import chamfer

    def run(key, table):
        y, x, v = (table.column(c).to_numpy() for c in ("y", "x", "v"))
        top, left = y.min(), x.min()
        mask = np.zeros((int(y.max() - top) + 1, int(x.max() - left) + 1), bool)
        mask[y - top, x - left] = v > 0
        d = np.minimum(chamfer(mask), 1e6)
        pad = np.pad(d, 1)
        peak = mask & (d >= np.max([pad[1 + a : 1 + a + d.shape[0], 1 + b : 1 + b + d.shape[1]] for a in (-1, 0, 1) for b in (-1, 0, 1)], axis=0))
        py, px = np.nonzero(peak)
        best = np.lexsort((px, py, -d[py, px]))[:segments]
        seeds = np.zeros(mask.shape, np.int64)
        seeds[py[best], px[best]] = np.arange(1, len(best) + 1)
        label = watershed_labels(-d, seeds, mask)
        return pa.table([table.column("image_id"), table.column("y"), table.column("x"), pa.array(label[y - top, x - left])], names=["image_id", "y", "x", "segment"])

    return binary.select(*KEY, "v").groupBy("image_id").applyInArrow(run, "image_id long, y long, x long, segment long")


def black_sources(pixels: DataFrame, segment: str = "segment") -> DataFrame:
    """(image_id, segment, pixels, black): black pixels of every segment."""
    return pixels.groupBy("image_id", segment).agg(F.count("*").alias("pixels"), F.count_if(F.col("r") + F.col("g") + F.col("b") == 0).alias("black"))
