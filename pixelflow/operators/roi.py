"""Regions of interest: component filters, splits, hierarchy and thinness."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import durable
from ..functions import color
from . import components as cc
from . import edges as ed
from . import grid

KEY = ["image_id", "y", "x"]


def remove_sparse(binary: DataFrame, density: DataFrame, min_size: int, threshold: float, foreground: bool = True) -> DataFrame:
    """Components smaller than min_size whose mean density is under the threshold change sides.

    density: (image_id, y, x, hits, ...) with `hits` in integers; `threshold` is in hits.
    """
    side = "v > 0" if foreground else "v = 0"
    labels = cc.label(binary.where(side))
    known = labels.join(density.select(*KEY, "hits"), KEY)
    small = known.groupBy("image_id", "label").agg(F.count("*").alias("area"), F.sum("hits").alias("total")).where((F.col("area") < min_size) & (F.col("total") < F.col("area") * F.lit(threshold)))
    flip = labels.join(small, ["image_id", "label"], "left_semi").select(*KEY, F.lit(True).alias("_flip"))
    to = 0 if foreground else 255
    return binary.join(flip, KEY, "left").withColumn("v", F.when(F.col("_flip"), to).otherwise(F.col("v")).cast("long")).drop("_flip")


def remove_noise(binary: DataFrame, min_size: int, threshold: float, window: int) -> DataFrame:
    """remove_sparse for white, then for black, with one density map."""
    hits = grid.density(binary, window)
    once = remove_sparse(binary, hits, min_size, threshold, True)
    return remove_sparse(once, hits, min_size, threshold, False)


def remove_small(binary: DataFrame, min_size: int) -> DataFrame:
    """3x3 closing, then 8-connected components of min_size or more."""
    closed = grid.close(binary, 3)
    labels = cc.label(closed.where("v > 0"))
    kept = labels.join(cc.stats(labels).where(F.col("area") >= min_size), ["image_id", "label"], "left_semi").select(*KEY, F.lit(255).cast("long").alias("_keep"))
    return closed.join(kept, KEY, "left").withColumn("v", F.coalesce("_keep", F.lit(0).cast("long"))).drop("_keep")


def fill_holes(binary: DataFrame, low: int = 10, high: int = 10000, eight: bool = False) -> DataFrame:
    """Black components with an area from low to high become white."""
    labels = cc.label(binary.where("v = 0"), eight)
    holes = labels.join(cc.stats(labels).where(F.col("area").between(low, high)), ["image_id", "label"], "left_semi").select(*KEY, F.lit(255).cast("long").alias("_fill"))
    return binary.join(holes, KEY, "left").withColumn("v", F.coalesce("_fill", "v")).drop("_fill")


def split_masks(binary: DataFrame, buffer: int = 3) -> DataFrame:
    """(image_id, y, x, roi, nonroi): both sides grown by `buffer` cross dilations; they overlap near borders."""
    both = binary.select(*KEY, F.when(F.col("v") > 0, 255).otherwise(0).cast("long").alias("a"), F.when(F.col("v") > 0, 0).otherwise(255).cast("long").alias("b"))
    grown = grid.dilate_cross(grid.dilate_cross(both, buffer, "a"), buffer, "b")
    return grown.select(*KEY, (F.col("a") > 0).alias("roi"), (F.col("b") > 0).alias("nonroi"))


def split_disjoint(binary: DataFrame) -> DataFrame:
    return binary.select(*KEY, (F.col("v") > 0).alias("roi"), (F.col("v") <= 0).alias("nonroi"))


def small_limit(size: Column) -> Column:
    """ceil(size / 10 ** (ceil(log10 size) - 3)); size counts channels."""
    return F.ceil(size / F.pow(F.lit(10.0), F.ceil(F.log10(size)) - 3))


def regions(masks: DataFrame) -> DataFrame:
    """(image_id, kind, label, top, left, height, width, area): both masks' components; small ROI ones become non-ROI."""
    size = masks.groupBy("image_id").agg((F.count("*") * 3).alias("size"))
    found = None
    for kind in ("roi", "nonroi"):
        own = cc.stats(cc.label(masks.where(kind))).withColumn("kind", F.lit(kind))
        found = own if found is None else found.unionByName(own)
    limit = small_limit(F.col("size"))
    return found.join(size, "image_id").withColumn("kind", F.when((F.col("kind") == "roi") & (F.col("area") < limit), "nonroi").otherwise(F.col("kind"))).drop("size")


def region_pixels(masks: DataFrame, kind: str) -> DataFrame:
    """(image_id, kind, label, y, x) of one mask's components."""
    return cc.label(masks.where(kind)).select("image_id", F.lit(kind).alias("kind"), "label", "y", "x")


def swap_small(masks: DataFrame) -> DataFrame:
    """Regions of both kinds after small ones changed sides, with touching ones fused: (image_id, kind, label, y, x)."""
    size = masks.groupBy("image_id").agg((F.count("*") * 3).alias("size"))
    moved = None
    for kind, other in (("roi", "nonroi"), ("nonroi", "roi")):
        labels = cc.label(masks.where(kind))
        small = cc.stats(labels).join(size, "image_id").where(F.col("area") < small_limit(F.col("size")))
        marked = labels.join(small.select("image_id", "label", F.lit(other).alias("to")), ["image_id", "label"], "left")
        own = marked.select(*KEY, F.coalesce("to", F.lit(kind)).alias("kind"))
        moved = own if moved is None else moved.unionByName(own)
    moved = moved.distinct()
    fused = None
    for kind in ("roi", "nonroi"):
        own = cc.label(moved.where(F.col("kind") == kind)).select("image_id", F.lit(kind).alias("kind"), "label", "y", "x")
        fused = own if fused is None else fused.unionByName(own)
    return fused


def hierarchy(labels: DataFrame) -> DataFrame:
    """(image_id, label, parent_label): the other component at a bounding box's centre."""
    s = cc.stats(labels).selectExpr("image_id", "label", "top + cast(floor(height / 2) as bigint) as y", "left + cast(floor(width / 2) as bigint) as x")
    at = labels.withColumnRenamed("label", "parent_label")
    return s.join(at, KEY).where("label <> parent_label").select("image_id", "label", "parent_label")


def contextual_clean(binary: DataFrame, k: int = 3, relative: float = 0.1, absolute: int = 10) -> DataFrame:
    """Opening, then components go that are under `absolute`, or under `relative` of their parent's area."""
    opened = grid.open_(binary, k)
    labels = cc.label(opened.where("v > 0"))
    area = cc.stats(labels).select("image_id", "label", "area")
    up = hierarchy(labels).join(area.withColumnsRenamed({"label": "parent_label", "area": "parent_area"}), ["image_id", "parent_label"])
    kept = area.join(up, ["image_id", "label"], "left").where((F.col("area") >= absolute) & (F.col("parent_area").isNull() | (F.col("area") >= F.col("parent_area") * relative)))
    keep = labels.join(kept, ["image_id", "label"], "left_semi").select(*KEY, F.lit(255).cast("long").alias("_keep"))
    return opened.join(keep, KEY, "left").withColumn("v", F.coalesce("_keep", F.lit(0).cast("long"))).drop("_keep")


def perimeter(labels: DataFrame) -> DataFrame:
    """(image_id, label, edges): pixel sides on a component's border."""
    sides = labels.sparkSession.createDataFrame([(0, 1), (1, 0), (0, -1), (-1, 0)], "dy long, dx long")
    near = labels.crossJoin(F.broadcast(sides)).select("image_id", "label", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"))
    return near.join(labels, ["image_id", "label", "y", "x"], "left_anti").groupBy("image_id", "label").agg(F.count("*").alias("edges"))


def thinness(labels: DataFrame) -> DataFrame:
    """stats with `edges`, `compactness` (4 pi area / edges^2), `aspect`, `fill` and their mean `thinness`."""
    s = cc.stats(labels).join(perimeter(labels), ["image_id", "label"])
    s = s.withColumn("compactness", F.least(F.lit(1.0), F.lit(4 * np.pi) * F.col("area") / (F.col("edges") * F.col("edges"))))
    s = s.withColumns({"aspect": F.least("height", "width") / F.greatest("height", "width"), "fill": F.col("area") / (F.col("height") * F.col("width"))})
    return s.withColumn("thinness", (F.col("compactness") + F.col("aspect") + F.col("fill")) / 3)


def thin_score(s: DataFrame) -> DataFrame:
    """Weighted score of aspect, fill and compactness (.3 .25 .25, .2 for one-pixel lines), clamped to 0..1."""
    line = F.when(F.least("height", "width") <= 1, 1.0).otherwise(0.0)
    raw = (1 - F.col("aspect")) * 0.3 + (1 - F.col("fill")) * 0.25 + (1 - F.col("compactness")) * 0.25 + line * 0.2
    return s.withColumn("thin_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def border(mask: np.ndarray) -> np.ndarray:
    """The outer border of a component as (row, column) in clockwise order from its first pixel, thin parts there and back."""
    turn = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]  # clockwise, from the east
    pad = np.pad(mask, 1)
    y, x = (int(v[0]) for v in np.nonzero(pad))
    start, out = (y, x), [(y, x)]
    back = 4  # the first pixel in raster order has nothing to its west
    first = None
    while True:
        for k in range(1, 9):
            d = (back + k) % 8
            if pad[y + turn[d][0], x + turn[d][1]]:
                break
        else:
            break  # a single pixel
        if (y, x) == start and first == d:
            out.pop()
            break
        first = d if first is None else first
        y, x = y + turn[d][0], x + turn[d][1]
        out.append((y, x))
        back = (d + 4) % 8
    return np.array(out) - 1


def contours(labels: DataFrame) -> DataFrame:
    """(image_id, label, seq, y, x): each component's outer border in order; one task for each component."""

    def run(key, table):
        y, x = (table.column(c).to_numpy() for c in ("y", "x"))
        top, left = y.min(), x.min()
        mask = np.zeros((int(y.max() - top) + 1, int(x.max() - left) + 1), bool)
        mask[y - top, x - left] = True
        line = border(mask)
        n = len(line)
        return pa.table([pa.array([key[0].as_py()] * n, pa.int64()), pa.array([key[1].as_py()] * n, pa.int64()), pa.array(np.arange(n)), pa.array(line[:, 0] + top), pa.array(line[:, 1] + left)], names=["image_id", "label", "seq", "y", "x"])

    return labels.select("image_id", "label", "y", "x").groupBy("image_id", "label").applyInArrow(run, "image_id long, label long, seq long, y long, x long")


def arc_perimeter(lines: DataFrame) -> DataFrame:
    """(image_id, label, points, arc): the length of each closed contour."""
    w = Window.partitionBy("image_id", "label").orderBy("seq")
    whole = Window.partitionBy("image_id", "label")
    ends = {c: F.coalesce(F.lead(c).over(w), F.min_by(c, "seq").over(whole)) - F.col(c) for c in ("y", "x")}
    steps = lines.withColumns({f"d{c}": e for c, e in ends.items()})
    return steps.groupBy("image_id", "label").agg(F.count("*").alias("points"), F.sum(F.sqrt((F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")).cast("double"))).alias("arc"))


def contour_thinness(labels: DataFrame) -> DataFrame:
    """stats with `arc`, `compactness` (4 pi area / arc^2, 0 for a lone pixel), `aspect`, `fill` and their mean `thinness`."""
    s = cc.stats(labels).join(arc_perimeter(contours(labels)), ["image_id", "label"])
    s = s.withColumn("compactness", F.when(F.col("arc") > 0, F.lit(4 * np.pi) * F.col("area") / (F.col("arc") * F.col("arc"))).otherwise(0.0))
    s = s.withColumns({"aspect": F.least("height", "width") / F.greatest("height", "width"), "fill": F.col("area") / (F.col("height") * F.col("width"))})
    return s.withColumn("thinness", (F.col("compactness") + F.col("aspect") + F.col("fill")) / 3)


def thin_by_heuristic(labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(image_id, label) under the threshold by `contour_thinness`, of those whose aspect times fill is under 1.5 times it."""
    box = cc.stats(labels).where(F.least("height", "width") / F.greatest("height", "width") * F.col("area") / (F.col("height") * F.col("width")) < threshold * 1.5)
    likely = labels.join(box, ["image_id", "label"], "left_semi")
    return contour_thinness(likely).where(F.col("thinness") < threshold).select("image_id", "label")


def box_thinness(s: DataFrame) -> DataFrame:
    """stats with `thin_box` from boxes and areas alone: .7 of the aspect, .3 of a square's perimeter over the box's; lines and
    components of up to 4 pixels by rules of their own. Lower is thinner."""
    long, short = F.greatest("height", "width"), F.least("height", "width")
    tiny = F.when(short == 1, 0.0).otherwise(0.5)
    line = (F.when(F.col("width") > 1, F.lit(1.0) / F.col("width")).otherwise(0.0) + F.when(F.col("height") > 1, F.lit(1.0) / F.col("height")).otherwise(0.0)) / 2
    mixed = short / long * 0.7 + F.sqrt("area") * 4 / ((F.col("height") + F.col("width")) * 2) * 0.3
    return s.withColumn("thin_box", F.when(F.col("area") <= 4, tiny).when(short == 1, line).otherwise(color.clip(mixed, 0.0, 1.0)))


def fast_thinness(s: DataFrame) -> DataFrame:
    """stats with `thin_fast`: aspect .3, fill .25, compactness .25 by a perimeter guessed from box and area, root of fill .15 and
    .05 for having area for its length. Lower is thinner."""
    long, short = F.greatest("height", "width"), F.least("height", "width")
    aspect, fill = short / long, F.col("area") / (F.col("height") * F.col("width"))
    around = (F.col("height") + F.col("width")) + F.sqrt(F.lit(np.pi) * F.col("area")) * 2 * (1 - aspect) * 0.25 + long * 2 * aspect * 0.25
    compact = color.clip(F.lit(4 * np.pi) * F.col("area") / (around * around), 0.0, 1.0)
    score = aspect * 0.3 + fill * 0.25 + compact * 0.25 + F.sqrt(fill) * 0.15 + (1 - F.least(F.lit(1.0), long / F.col("area") / 10)) * 0.05
    return s.withColumn("thin_fast", color.clip(score, 0.0, 1.0))


def thin_by_boxes(labels: DataFrame, threshold: float = 0.3, low: int = 10, high: int = 1000) -> DataFrame:
    """(image_id, label) of components of low to high pixels whose `thin_box` is under the threshold."""
    return box_thinness(cc.stats(labels).where(F.col("area").between(low, high))).where(F.col("thin_box") < threshold).select("image_id", "label")


def chamfer(mask: np.ndarray) -> np.ndarray:
    """Distance to the nearest 0 by two chamfer passes (steps 0.955 and 1.3693); inside a mask without zeros it stays large."""
    a, b = 0.955, 1.3693
    d = np.pad(np.where(mask, 1e9, 0.0), 1, constant_values=1e9)
    for flip in (False, True):
        if flip:
            d = d[::-1, ::-1]
        for y in range(1, d.shape[0] - 1):
            up = np.minimum(np.minimum(d[y - 1, :-2] + b, d[y - 1, 1:-1] + a), d[y - 1, 2:] + b)
            row = np.minimum(d[y, 1:-1], up)
            steps = np.arange(len(row)) * a
            d[y, 1:-1] = np.minimum.accumulate(row - steps) + steps  # from the left
        if flip:
            d = d[::-1, ::-1]
    return d[1:-1, 1:-1]


def distances(binary: DataFrame) -> DataFrame:
    """(image_id, y, x, d): chamfer distance of every pixel to black; one task for each image."""

    def run(key, table):
        y, x, v = (table.column(c).to_numpy() for c in ("y", "x", "v"))
        top, left = y.min(), x.min()
        mask = np.zeros((int(y.max() - top) + 1, int(x.max() - left) + 1), bool)
        mask[y - top, x - left] = v > 0
        d = chamfer(mask)
        return pa.table([table.column("image_id"), table.column("y"), table.column("x"), pa.array(d[y - top, x - left], pa.float64())], names=["image_id", "y", "x", "d"])

    return binary.select(*KEY, "v").groupBy("image_id").applyInArrow(run, "image_id long, y long, x long, d double")


def thin_components(binary: DataFrame, threshold: float = 0.3, min_size: int = 10) -> DataFrame:
    """(image_id, label): components with 1 - 2 * mean distance / longer side over the threshold."""
    labels = cc.label(binary.where("v > 0"))
    known = labels.join(distances(binary), KEY)
    s = cc.stats(known, F.avg("d").alias("mean_d"))
    return s.where((F.col("area") >= min_size) & (1 - F.col("mean_d") * 2 / F.greatest("height", "width") > threshold)).select("image_id", "label")


def remove_thin(binary: DataFrame, max_density: float = 0.1, threshold: float = 0.3, window: int = 25) -> DataFrame:
    """Thin components go whose mean density is under max_density."""
    labels = cc.label(binary.where("v > 0"))
    thin = thin_components(binary, threshold)
    sparse = labels.join(thin, ["image_id", "label"], "left_semi").join(grid.density(binary, window).select(*KEY, "density"), KEY).groupBy("image_id", "label").agg(F.avg("density").alias("m")).where(F.col("m") < max_density)
    gone = labels.join(sparse, ["image_id", "label"], "left_semi").select(*KEY, F.lit(True).alias("_gone"))
    return binary.join(gone, KEY, "left").withColumn("v", F.when(F.col("_gone"), 0).otherwise(F.col("v")).cast("long")).drop("_gone")


def unify(binary: DataFrame) -> DataFrame:
    """Borders, protection, gap bridging, hole filling, small components: the region map of an edge map."""
    borders = grid.meaningful_borders(binary, 0.5).transform(durable)
    protected = grid.protect_borders(binary, borders, 15).transform(durable)
    bridged = grid.bridge_gaps(protected, 25, 0.2, 15, 25).transform(durable)
    return remove_small(fill_holes(bridged, 10, 10000, False).transform(durable), 5).transform(durable)


def detect(edges: DataFrame) -> DataFrame:
    """ROI masks of an edge map: thin structures and noise go, gaps close, both sides grow a buffer."""
    thin = remove_thin(edges, 0.1, 0.3, 25).transform(durable)
    clean = remove_noise(thin, 75, 0.1 * 25 * 25, 25).transform(durable)
    closed = grid.connect_by_closing(clean, 5).transform(durable)
    bridged = grid.bridge_gaps(closed, 100, 0.2, 15, 25).transform(durable)
    return split_masks(unify(bridged), 3)


def dense_edges(edges: DataFrame, share: float = 0.01) -> DataFrame:
    """Edge pixels whose 3x3 density is over `share` of the mean density at edges, as 255; the rest is 0."""
    dense = grid.density(edges, 3).transform(durable)
    level = ed.suggest(dense, edges).select("image_id", (F.col("mean") * share).alias("level"))
    met = dense.join(level, "image_id")
    return met.select(*KEY, F.when((F.col("v") > 0) & (F.col("density") > F.col("level")), 255).otherwise(0).cast("long").alias("v"))


def image_masks(pixels: DataFrame) -> DataFrame:
    """(image_id, y, x, roi, nonroi) of colour images, end to end: best thresholds on gray, Canny on colour, density filter, `detect`."""
    limits = ed.best_limits(pixels.select(*KEY, color.gray().alias("v")).transform(durable))
    edges = ed.canny_rgb(pixels, limits).transform(durable)
    return detect(dense_edges(edges).transform(durable))


def skeleton(mask: np.ndarray) -> np.ndarray:
    """Zhang-Suen thinning."""
    img = np.pad(mask.astype(np.uint8), 1)
    while True:
        changed = False
        for step in (0, 1):
            p = [img[:-2, 1:-1], img[:-2, 2:], img[1:-1, 2:], img[2:, 2:], img[2:, 1:-1], img[2:, :-2], img[1:-1, :-2], img[:-2, :-2]]
            count = sum(x.astype(int) for x in p)
            turns = sum(((p[i] == 0) & (p[(i + 1) % 8] == 1)).astype(int) for i in range(8))
            n, e, s, w = p[0], p[2], p[4], p[6]
            edge = (n * e * s == 0) & (e * s * w == 0) if step == 0 else (n * e * w == 0) & (n * s * w == 0)
            gone = (img[1:-1, 1:-1] == 1) & (count >= 2) & (count <= 6) & (turns == 1) & edge
            if gone.any():
                img[1:-1, 1:-1][gone] = 0
                changed = True
        if not changed:
            return img[1:-1, 1:-1].astype(bool)


def connect_by_skeleton(binary: DataFrame, distance: int = 5) -> DataFrame:
    """The skeleton of all pixels within `distance` of white joins the map; one task for each image."""

    def run(key, table):
        y, x, v = (table.column(c).to_numpy() for c in ("y", "x", "v"))
        top, left = y.min(), x.min()
        white = np.zeros((int(y.max() - top) + 1, int(x.max() - left) + 1), bool)
        white[y - top, x - left] = v > 0
        out = white | skeleton(chamfer(~white) <= distance)
        return pa.table([table.column("image_id"), table.column("y"), table.column("x"), pa.array(np.where(out[y - top, x - left], 255, 0), pa.int64())], names=["image_id", "y", "x", "v"])

    return binary.select(*KEY, "v").groupBy("image_id").applyInArrow(run, "image_id long, y long, x long, v long")


def connect_by_dilation(binary: DataFrame, distance: int = 5, min_size: int = 5) -> DataFrame:
    """Components under min_size go, then an elliptical dilation and erosion."""
    labels = cc.label(binary.where("v > 0"))
    kept = labels.join(cc.stats(labels).where(F.col("area") >= min_size), ["image_id", "label"], "left_semi").select(*KEY, F.lit(255).cast("long").alias("_keep"))
    big = binary.join(kept, KEY, "left").withColumn("v", F.coalesce("_keep", F.lit(0).cast("long"))).drop("_keep")
    return grid.connect_by_closing(big, distance)


def connect_by_growing(binary: DataFrame, distance: int = 5, min_size: int = 5) -> DataFrame:
    """Every component of min_size or more grows by an elliptical dilation; the union of all is that of one dilation."""
    labels = cc.label(binary.where("v > 0"))
    kept = labels.join(cc.stats(labels).where(F.col("area") >= min_size), ["image_id", "label"], "left_semi").select(*KEY, F.lit(255).cast("long").alias("_keep"))
    big = binary.join(kept, KEY, "left").withColumn("_keep", F.coalesce("_keep", F.lit(0).cast("long")))
    grown = grid.dilate_ellipse(big, distance, "_keep")
    return grown.withColumn("v", F.greatest("v", "_keep")).drop("_keep")


def tight_boxes(labels: DataFrame) -> DataFrame:
    """(image_id, label, minr, minc, maxr, maxc, area): exclusive boxes, clamped to the image; one-pixel-thin ones get one more."""
    size = labels.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    s = cc.stats(labels).join(size, "image_id")
    thin = F.when((F.col("height") == 1) | (F.col("width") == 1), 1).otherwise(0)
    return s.select("image_id", "label", F.col("top").alias("minr"), F.col("left").alias("minc"), F.least("h", F.col("top") + F.col("height") + thin).alias("maxr"), F.least("w", F.col("left") + F.col("width") + thin).alias("maxc"), "area")


def connect_by_centroids(binary: DataFrame, distance: int = 5, min_size: int = 1) -> DataFrame:
    """Cells (pixels of one nearest component centroid) whose centroid has two or more centroids, itself included,
    within 2 * distance are filled with that reach."""
    labels = cc.label(binary.where("v > 0"))
    centres = labels.groupBy("image_id", "label").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.count("*").alias("n")).where(F.col("n") >= min_size)
    cell = 2 * distance
    spot = centres.withColumns({"by": F.floor(F.col("cy") / cell), "bx": F.floor(F.col("cx") / cell)})
    near = spot.withColumn("by", F.explode(F.array(*(F.col("by") + d for d in (-1, 0, 1))))).withColumn("bx", F.explode(F.array(*(F.col("bx") + d for d in (-1, 0, 1)))))
    other = near.selectExpr("image_id", "by", "bx", "label as other", "cy as oy", "cx as ox")
    joined = spot.join(other, ["image_id", "by", "bx"]).where((F.pow(F.col("cy") - F.col("oy"), 2) + F.pow(F.col("cx") - F.col("ox"), 2)) <= float(cell * cell))
    busy = joined.groupBy("image_id", "label", "cy", "cx").agg(F.count("*").alias("near")).where("near >= 2")
    reach = busy.select("image_id", F.explode(F.sequence(F.floor(F.col("cy") - distance), F.ceil(F.col("cy") + distance))).alias("y"), "cy", "cx").select("image_id", "y", F.explode(F.sequence(F.floor(F.col("cx") - distance), F.ceil(F.col("cx") + distance))).alias("x"), "cy", "cx")
    fill = reach.where((F.pow(F.col("y") - F.col("cy"), 2) + F.pow(F.col("x") - F.col("cx"), 2)) <= float(distance * distance)).select(*KEY, F.lit(255).cast("long").alias("_fill")).distinct()
    return binary.join(fill, KEY, "left").withColumn("v", F.coalesce("_fill", "v")).drop("_fill")
