"""Palettes: distinct colours, indices, clustering of colours, and remapping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from ..functions.durable import durable
from .components import closure, label, stats

RGB = ["r", "g", "b"]
CELLS = 1 << 20  # distances that k-means holds at a time


def distinct(pixels: DataFrame) -> DataFrame:
    """(image_id, idx, r, g, b): distinct colours in lexicographic order, numbered from 0."""
    w = Window.partitionBy("image_id").orderBy(*RGB)
    return pixels.select("image_id", *RGB).distinct().select("image_id", (F.row_number().over(w) - 1).cast("long").alias("idx"), *RGB)


def indices(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """(image_id, y, x, idx) of every pixel."""
    return pixels.join(palette, ["image_id", *RGB]).select("image_id", "y", "x", "idx")


def gather(index: DataFrame, palette: DataFrame) -> DataFrame:
    """(image_id, y, x, r, g, b): the decoded pixels."""
    return index.join(palette, ["image_id", "idx"]).select("image_id", "y", "x", *RGB)


def params(counts: DataFrame, quality: int) -> DataFrame:
    """counts(image_id, n) with eps and most, the cluster radius and size that a quality asks for."""
    if quality <= 0:
        raise ValueError("quality must be over 0")
    eps = 128 - 1.28 * quality
    return counts.withColumns({"eps": F.lit(1.0 if eps == 0 else eps), "most": F.greatest(F.lit(1), F.ceil((F.col("n") - F.col("n") * (quality / 100)) / quality)).cast("long"), "min_samples": F.lit(1)})


def eps_clusters(palette: DataFrame, eps: float) -> DataFrame:
    """(image_id, idx, r, g, b, cluster): components of the graph of colours within eps; black keeps to itself.

    Colours fall into cells of side eps / sqrt(3), whose members are all linked; only cells are joined, with the
    cells in reach, and a pair of cells keeps one link. cluster is the least idx.
    """
    side = eps / 3**0.5
    colours = palette.where("r + g + b > 0").withColumns({f"c{c}": F.floor(F.col(c) / side).cast("long") for c in RGB})
    cell = ["image_id", "cr", "cg", "cb"]
    homes = colours.groupBy(*cell).agg(F.min("idx").alias("home"))
    own = colours.join(homes, cell)
    steps = palette.sparkSession.createDataFrame([(a, b, c) for a in range(-2, 3) for b in range(-2, 3) for c in range(-2, 3) if (a, b, c) > (0, 0, 0)], "dr long, dg long, db long")
    near = own.crossJoin(F.broadcast(steps)).select("image_id", *((F.col(f"c{c}") + F.col(f"d{c}")).alias(f"c{c}") for c in RGB), *(F.col(c).alias(f"{c}1") for c in RGB), F.col("home").alias("a"))
    met = near.join(own, cell).where(F.expr("(r - r1) * (r - r1) + (g - g1) * (g - g1) + (b - b1) * (b - b1)") <= eps * eps)
    links = met.select("image_id", "a", F.col("home").alias("b")).distinct()
    node = lambda c: F.struct("image_id", F.col(c).alias("idx"))
    roots = closure(links.select(node("a").alias("a"), node("b").alias("b"))).select(F.col("node.image_id").alias("image_id"), F.col("node.idx").alias("home"), F.col("root.idx").alias("cluster"))
    found = own.join(roots, ["image_id", "home"], "left").select("image_id", "idx", *RGB, F.coalesce("cluster", "home").alias("cluster"))
    return found.unionByName(palette.where("r + g + b = 0").select("image_id", "idx", *RGB, F.lit(-1).cast("long").alias("cluster")))


def cluster_means(clustered: DataFrame) -> DataFrame:
    """(image_id, cluster, n, r, g, b): truncated means."""
    return clustered.groupBy("image_id", "cluster").agg(F.count("*").alias("n"), *(F.floor(F.sum(c) / F.count("*")).cast("long").alias(c) for c in RGB))


def luma_split(clustered: DataFrame, most: int) -> DataFrame:
    """clustered with `part`: clusters over `most` colours, in order of luma, cut into near-equal runs."""
    w = Window.partitionBy("image_id", "cluster")
    at = clustered.withColumns({"n": F.count("*").over(w), "rn": F.row_number().over(w.orderBy(color.luma(), *RGB)) - 1})
    k = F.ceil(F.col("n") / F.lit(most))
    at = at.withColumn("k", k).withColumns({"low": F.floor(F.col("n") / F.col("k")), "extra": F.col("n") % F.col("k")})
    big = F.col("extra") * (F.col("low") + 1)
    part = F.when(F.col("rn") < big, F.floor(F.col("rn") / (F.col("low") + 1))).otherwise(F.col("extra") + F.floor((F.col("rn") - big) / F.col("low")))
    return at.withColumn("part", part.cast("long")).drop("n", "rn", "k", "low", "extra")


def lloyd(points: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """k-means labels from fixed starts: the luma order's quantiles."""
    order = np.lexsort((points[:, 2], points[:, 1], points[:, 0], points @ np.array([299, 587, 114])))
    centres = points[order[(np.arange(k) * 2 + 1) * len(points) // (2 * k)]].astype(float)
    label = np.zeros(len(points), np.int64)
    held = max(1, CELLS // k)
    for _ in range(rounds):
        after = np.concatenate([((points[lo : lo + held, None, :] - centres) ** 2).sum(axis=2).argmin(axis=1) for lo in range(0, len(points), held)])
        if np.array_equal(after, label) and _:
            break
        label = after
        for c in range(k):
            if (label == c).any():
                centres[c] = points[label == c].mean(axis=0)
    return label


def _split(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Parts (row numbers) of at most `most` colours."""
    todo, done = [np.arange(len(points))], []
    while todo:
        own = todo.pop()
        if len(own) <= max(1, most):
            done.append(own)
            continue
        label = lloyd(points[own], min(len(own), max(2, -(-len(own) // most))))
        parts = [own[label == c] for c in np.unique(label)]
        if len(parts) == 1:
            parts = np.array_split(own, 2)
        todo += parts
    return sorted(done, key=lambda p: tuple(points[p].min(axis=0)))


def kmeans_split(clustered: DataFrame, most: int | None = None) -> DataFrame:
    """clustered with `part`: clusters over `most` colours (a number, or a column of that name) split by k-means, again
    and again; one task for each cluster."""
    limit = F.col("most") if most is None else F.lit(most)

    def run(key, table):
        most = table.column("most")[0].as_py()
        table = table.drop_columns(["most"])
        points = np.column_stack([table.column(c).to_numpy() for c in RGB]).astype(np.int64)
        part = np.zeros(len(points), np.int64)
        for number, own in enumerate(_split(points, most)):
            part[own] = number
        return table.append_column("part", pa.array(part, pa.int64()))

    return clustered.select("image_id", "cluster", "idx", *RGB, limit.cast("long").alias("most")).groupBy("image_id", "cluster").applyInArrow(run, "image_id long, cluster long, idx long, r long, g long, b long, part long")


def reduced(split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new palette (image_id, idx, r, g, b) of (cluster, part) means, black first, and old idx -> new idx."""
    means = split.groupBy("image_id", "cluster", "part").agg(*(F.floor(F.sum(c) / F.count("*")).cast("long").alias(c) for c in RGB))
    palette = distinct(means)
    mapping = split.select("image_id", F.col("idx").alias("old"), "cluster", "part").join(means, ["image_id", "cluster", "part"]).join(palette, ["image_id", *RGB]).select("image_id", "old", "idx")
    return palette, mapping


def remap(index: DataFrame, mapping: DataFrame) -> DataFrame:
    """(image_id, y, x, idx) through mapping(image_id, old, idx); what isn't mapped becomes 0."""
    met = index.withColumnRenamed("idx", "old").join(mapping, ["image_id", "old"], "left")
    return met.select("image_id", "y", "x", F.coalesce("idx", F.lit(0)).cast("long").alias("idx"))


def quantize(pixels: DataFrame, quality: int) -> tuple[DataFrame, DataFrame]:
    """Palette and indices of one codec level: distinct colours, eps clusters, size-capped k-means, remap."""
    palette = distinct(pixels).transform(durable)
    most = params(palette.groupBy("image_id").agg(F.count("*").alias("n")), quality).select("image_id", "most")
    clusters = eps_clusters(palette, max(1.0, 128 - 1.28 * quality)).join(most, "image_id").transform(durable)
    fresh, mapping = reduced(kmeans_split(clusters).transform(durable))
    fresh, mapping = fresh.transform(durable), mapping.transform(durable)
    return fresh, remap(indices(pixels, palette), mapping)


def lookup(palette: DataFrame, colours: DataFrame) -> DataFrame:
    """colours(image_id, r, g, b) with idx, the first equal palette entry, null where there is none."""
    first = palette.groupBy("image_id", *RGB).agg(F.min("idx").alias("idx"))
    return colours.join(first, ["image_id", *RGB], "left")


def hierarchical(palette: DataFrame, quality: int) -> DataFrame:
    """k-means over the whole palette to max(2, n * quality / 100) colours: (image_id, idx, r, g, b, part)."""

    def run(key, table):
        points = np.column_stack([table.column(c).to_numpy() for c in RGB]).astype(np.int64)
        k = min(len(points), max(2, len(points) * quality // 100))
        return table.append_column("part", pa.array(lloyd(points, k), pa.int64()))

    return palette.select("image_id", "idx", *RGB).groupBy("image_id").applyInArrow(run, "image_id long, idx long, r long, g long, b long, part long")


def black_fix(pixels: DataFrame, segment: str = "segment") -> DataFrame:
    """Black pixels of a segment take its darkest other colour (by squared norm, then y, x); all-black segments stay."""
    norm = F.expr("r * r + g * g + b * b")
    dark = pixels.where("r + g + b > 0").groupBy("image_id", segment).agg(F.min_by(F.struct(*RGB), F.struct(norm, "y", "x")).alias("dark"))
    met = pixels.join(dark, ["image_id", segment], "left")
    is_black = (F.col("r") + F.col("g") + F.col("b") == 0) & F.col("dark").isNotNull()
    return met.withColumns({c: F.when(is_black, F.col(f"dark.{c}")).otherwise(F.col(c)) for c in RGB}).drop("dark")


def fill_black_holes(pixels: DataFrame, most: int = 10, eight: bool = False) -> DataFrame:
    """(image_id, y, x, r, g, b): black components of at most `most` pixels take the commonest colour of the other pixels next
    to them (the first in raster order on ties); a component without such a neighbour stays black."""
    key = ["image_id", "y", "x"]
    labels = label(pixels.where("r + g + b = 0"), eight)
    small = labels.join(stats(labels).where(F.col("area") <= most), ["image_id", "label"], "left_semi").transform(durable)
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (eight or not (a and b))]
    round_ = small.withColumn("s", F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in steps))))
    near = round_.select("image_id", "label", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x")).distinct()
    met = near.join(pixels.where("r + g + b > 0").select(*key, *RGB), key)
    counted = met.groupBy("image_id", "label", *RGB).agg(F.count("*").alias("n"), F.min(F.struct("y", "x")).alias("first"))
    fill = counted.groupBy("image_id", "label").agg(F.max_by(F.struct(*RGB), F.struct("n", -F.col("first.y"), -F.col("first.x"))).alias("fill"))
    spots = small.join(fill, ["image_id", "label"]).select(*key, "fill")
    return pixels.join(spots, key, "left").select(*key, *(F.coalesce(F.col(f"fill.{c}"), F.col(c)).alias(c) for c in RGB))
