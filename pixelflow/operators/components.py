"""Connected components: of pixels, by stripes and seams; of any edge table, by a closure."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import durable


def closure(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node that can be reached, for every node of an edge.

    Each round links all neighbours to the least one (minima combine before the shuffle), so
    chains shorten by halves; rounds are checkpointed in the session's checkpoint folder.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct().transform(durable)
    loops = now.where("u = v").select("u")
    now = now.where("u > v")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        now = large.join(low, "u").where("v > m").selectExpr("v as u", "m as v").union(low.selectExpr("u", "m as v")).distinct().transform(durable)
    roots = now.selectExpr("u as node", "v as root").union(now.selectExpr("v as node", "v as root").distinct())
    alone = loops.join(roots, loops["u"] == roots["node"], "left_anti").selectExpr("u as node", "u as root")
    return roots.union(alone)


def label_grid(y: np.ndarray, x: np.ndarray, eight: bool) -> np.ndarray:
    """For each foreground pixel the number of its component's first one, in raster order of (y, x)."""
    n = len(y)
    order = np.lexsort((x, y))
    y, x = y[order], x[order]
    width = int(x.max()) + 3
    place = y * width + x + 1
    pairs = []
    for step in (1, width, *((width - 1, width + 1) if eight else ())):
        at = np.searchsorted(place, place + step)
        ok = (at < n) & (place[np.minimum(at, n - 1)] == place + step)
        pairs.append(np.column_stack([np.flatnonzero(ok), at[ok]]))
    u, v = np.concatenate(pairs).T
    root = np.arange(n)
    while True:
        low = np.minimum(root[u], root[v])
        after = root.copy()
        np.minimum.at(after, root[u], low)
        np.minimum.at(after, root[v], low)
        while not np.array_equal(jumped := after[after], after):
            after = jumped
        if np.array_equal(after, root):
            break
        root = after
    out = np.empty(n, np.int64)
    out[order] = order[root]
    return out


def label(foreground: DataFrame, eight: bool = True, stripe: int = 512) -> DataFrame:
    """(image_id, y, x, label): components of a foreground relation (image_id, y, x); label 1, 2, ... in raster order of
    their first pixels.

    Stripes of rows are labelled apart, then labels that touch across a seam are joined by a closure,
    so no task holds more than a stripe.
    """
    cut = foreground.select("image_id", "y", "x").withColumn("stripe", F.expr(f"cast(floor(y / {stripe}) as bigint)"))

    def run(key, table):
        y, x = (table.column(c).to_numpy() for c in ("y", "x"))
        first = label_grid(y, x, eight)
        return pa.table([table.column("image_id"), table.column("y"), table.column("x"), pa.array(y[first], pa.int64()), pa.array(x[first], pa.int64())], names=["image_id", "y", "x", "ly", "lx"])

    own = cut.groupBy("image_id", "stripe").applyInArrow(run, "image_id long, y long, x long, ly long, lx long").transform(durable)
    node = F.struct("image_id", "ly", "lx")
    # seams: the last row of a stripe against the first of the next
    upper = own.where(F.expr(f"y % {stripe} = {stripe - 1}")).select("image_id", (F.col("y") + 1).alias("y"), "x", node.alias("a"))
    if eight:
        upper = upper.withColumn("x", F.explode(F.array(F.col("x") - 1, F.col("x"), F.col("x") + 1)))
    lower = own.where(F.expr(f"y % {stripe} = 0 and y > 0")).select("image_id", "y", "x", node.alias("b"))
    seams = upper.join(lower, ["image_id", "y", "x"]).select("a", "b")
    if seams.isEmpty():
        joined = own.withColumn("root", node)
    else:
        roots = closure(seams)
        joined = own.withColumn("node", node).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node")
    tops = joined.select("image_id", "root").distinct()
    numbers = tops.select("*", F.row_number().over(Window.partitionBy("image_id").orderBy("root")).cast("long").alias("label"))
    return joined.join(numbers, ["image_id", "root"]).select("image_id", "y", "x", "label")


def stats(labels: DataFrame, *more) -> DataFrame:
    """(image_id, label, top, left, height, width, area) and further aggregates of every component."""
    found = labels.groupBy("image_id", "label").agg(F.min("y").alias("top"), F.min("x").alias("left"), F.max("y").alias("_b"), F.max("x").alias("_r"), F.count("*").alias("area"), *more)
    return found.withColumns({"height": F.col("_b") - F.col("top") + 1, "width": F.col("_r") - F.col("left") + 1}).drop("_b", "_r")
