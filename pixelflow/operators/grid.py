"""Neighbourhood kernels on dense pixel grids.

All kernels are separable windows: one pass partitioned by (image, row), one by (image, column). They
sort each line once and never multiply rows by the kernel's size. `reflect` borders mirror without
repeating the edge; morphology leaves out what lies outside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def along_x():
    return Window.partitionBy("image_id", "y").orderBy("x")


def along_y():
    return Window.partitionBy("image_id", "x").orderBy("y")


def reflected(value: str, step: int, window) -> Column:
    """The neighbour one step before (-1) or after (1), mirrored at the border; a lone line repeats itself."""
    before, after = F.lag(value).over(window), F.lead(value).over(window)
    return F.coalesce(*((before, after) if step < 0 else (after, before)), F.col(value))


def sobel(pixels: DataFrame, value: str = "v") -> DataFrame:
    """pixels with gx and gy, the 3x3 Sobel responses."""
    left, right = reflected(value, -1, along_x()), reflected(value, 1, along_x())
    rows = pixels.withColumn("_d", right - left).withColumn("_s", left + F.col(value) * 2 + right)
    up_d, down_d = reflected("_d", -1, along_y()), reflected("_d", 1, along_y())
    return rows.withColumns({"gx": up_d + F.col("_d") * 2 + down_d, "gy": reflected("_s", 1, along_y()) - reflected("_s", -1, along_y())}).drop("_d", "_s")


def mirrored(df: DataFrame, half: int, axis: str) -> DataFrame:
    """df with copies of up to `half` mirrored pixels on either side of an axis: `_at` is the padded place."""
    line = ["image_id", "x" if axis == "y" else "y"]
    at = df.join(df.groupBy(*line).agg(F.max(axis).alias("_last")), line)
    none = F.array().cast("array<bigint>")
    before = F.when(F.col(axis).between(1, half), F.array(-F.col(axis))).otherwise(none)
    after = F.when(F.col(axis).between(F.col("_last") - half, F.col("_last") - 1), F.array(F.col("_last") * 2 - F.col(axis))).otherwise(none)
    return at.withColumn("_at", F.explode(F.concat(F.array(F.col(axis)), before, after))).drop("_last")


def _line_sum(df: DataFrame, value: str, half: int, axis: str) -> DataFrame:
    """Sums over 2 * half + 1 neighbours along an axis of a mirrored-padded line."""
    line = ["image_id", "x" if axis == "y" else "y"]
    w = Window.partitionBy(*line).orderBy("_at").rowsBetween(-half, half)
    return mirrored(df, half, axis).withColumn(value, F.sum(value).over(w)).where(F.col("_at") == F.col(axis)).drop("_at")


def box_sum(pixels: DataFrame, value: str, k: int, out: str) -> DataFrame:
    """Sums over k x k windows with mirrored borders; lines are longer than k / 2."""
    work = pixels.withColumn(out, F.col(value))
    return _line_sum(_line_sum(work, out, k // 2, "x"), out, k // 2, "y")


def density(binary: DataFrame, k: int = 15, value: str = "v") -> DataFrame:
    """binary with `hits`, the white pixels in each k x k window, and `density`, their share."""
    ones = binary.withColumn("_one", F.when(F.col(value) > 0, 1).otherwise(0).cast("long"))
    return box_sum(ones, "_one", k, "hits").drop("_one").withColumn("density", F.col("hits").cast("double") / F.lit(float(k * k)))


def _extreme(pixels: DataFrame, value: str, half: int, fn) -> DataFrame:
    rows = pixels.withColumn(value, fn(value).over(along_x().rowsBetween(-half, half)))
    return rows.withColumn(value, fn(value).over(along_y().rowsBetween(-half, half)))


def dilate(pixels: DataFrame, k: int = 3, value: str = "v") -> DataFrame:
    return _extreme(pixels, value, k // 2, F.max)


def erode(pixels: DataFrame, k: int = 3, value: str = "v") -> DataFrame:
    return _extreme(pixels, value, k // 2, F.min)


def close(pixels: DataFrame, k: int = 3, value: str = "v") -> DataFrame:
    return erode(dilate(pixels, k, value), k, value)


def open_(pixels: DataFrame, k: int = 3, value: str = "v") -> DataFrame:
    return dilate(erode(pixels, k, value), k, value)


def ellipse(radius: int) -> list[int]:
    """Half widths of the rows -radius..radius of an elliptical kernel."""
    return [round(radius * max(0.0, 1 - (dy / radius) ** 2) ** 0.5) if radius else 0 for dy in range(-radius, radius + 1)]


def _shaped(pixels: DataFrame, halves: list[int], value: str, fn, pick) -> DataFrame:
    """max or min over a kernel of one run per row: a window for each distinct width, then shifts along y."""
    radius = len(halves) // 2
    wide = pixels.withColumns({f"_w{h}": fn(value).over(along_x().rowsBetween(-h, h)) for h in sorted(set(halves))})
    shifted = [F.col(f"_w{h}") if i == radius else (F.lag(f"_w{h}", radius - i) if i < radius else F.lead(f"_w{h}", i - radius)).over(along_y()) for i, h in enumerate(halves)]
    out = pick(*shifted) if len(shifted) > 1 else shifted[0]
    return wide.withColumn("_out", out).withColumn(value, F.col("_out")).drop("_out", *(f"_w{h}" for h in sorted(set(halves))))


def dilate_ellipse(pixels: DataFrame, radius: int, value: str = "v") -> DataFrame:
    return _shaped(pixels, ellipse(radius), value, F.max, F.greatest)


def erode_ellipse(pixels: DataFrame, radius: int, value: str = "v") -> DataFrame:
    return _shaped(pixels, ellipse(radius), value, F.min, F.least)


def connect_by_closing(binary: DataFrame, distance: int, value: str = "v") -> DataFrame:
    """Elliptical closing of size 2 * distance + 1."""
    return erode_ellipse(dilate_ellipse(binary, distance, value), distance, value)


def dilate_cross(pixels: DataFrame, steps: int, value: str = "v") -> DataFrame:
    """`steps` dilations by the 4-connected cross: one kernel, a diamond."""
    return _shaped(pixels, [steps - abs(dy) for dy in range(-steps, steps + 1)], value, F.max, F.greatest)


def bridge_gaps(binary: DataFrame, max_gap: int = 25, threshold: float = 0.2, local: int = 15, regional: int = 25) -> DataFrame:
    """Black pixels with white ones on both sides of an axis (4 axes), in reach of min(max_gap, local), become
    white where the regional density is over the threshold. The grid is mirrored at its border."""
    reach = min(max_gap, local)
    dense = density(binary, regional)
    padded = mirrored(dense, reach, "x").withColumnRenamed("_at", "_px")
    size = padded.groupBy("image_id", "_px").agg(F.max("y").alias("_last"))
    none = F.array().cast("array<bigint>")
    before = F.when(F.col("y").between(1, reach), F.array(-F.col("y"))).otherwise(none)
    after = F.when(F.col("y").between(F.col("_last") - reach, F.col("_last") - 1), F.array(F.col("_last") * 2 - F.col("y"))).otherwise(none)
    out = padded.join(size, ["image_id", "_px"]).withColumn("_py", F.explode(F.concat(F.array(F.col("y")), before, after)))
    # white places along each axis: how far the last and the next one are
    axes = {"h": (F.col("_py"), "_px"), "v": (F.col("_px"), "_py"), "d": (F.col("_py") - F.col("_px"), "_px"), "a": (F.col("_py") + F.col("_px"), "_px")}
    for name, (line, along) in axes.items():
        spot = F.when(F.col("v") > 0, F.col(along))
        w = Window.partitionBy("image_id", line).orderBy(along)
        last = F.last(spot, ignorenulls=True).over(w.rowsBetween(-reach, -1))
        following = F.first(spot, ignorenulls=True).over(w.rowsBetween(1, reach))
        out = out.withColumn(f"_{name}", (F.col(along) - last <= reach) & (following - F.col(along) <= reach))
    out = out.where("_px = x and _py = y")
    any_axis = F.coalesce("_h", F.lit(False)) | F.coalesce("_v", F.lit(False)) | F.coalesce("_d", F.lit(False)) | F.coalesce("_a", F.lit(False))
    filled = F.when((F.col("v") == 0) & (F.col("density") > threshold) & any_axis, F.lit(255).cast("long")).otherwise(F.col("v"))
    return out.withColumn("v", filled).drop("_h", "_v", "_d", "_a", "_px", "_py", "_last", "hits", "density")


def _sides(binary: DataFrame, reach: int) -> DataFrame:
    """binary with left, right, up, down: whether white stands within reach; outside there is none."""
    out = binary
    for window, before, after in ((along_x(), "left", "right"), (along_y(), "up", "down")):
        at = F.max("v").over(window.rowsBetween(-reach, -1)), F.max("v").over(window.rowsBetween(1, reach))
        out = out.withColumns({before: F.coalesce(at[0] > 0, F.lit(False)), after: F.coalesce(at[1] > 0, F.lit(False))})
    return out


def _clipped(pixels: DataFrame, value: str, half: int, fn, out: str) -> DataFrame:
    """fn over windows that are cut off at the border."""
    rows = pixels.withColumn(out, fn(value).over(along_x().rowsBetween(-half, half)))
    return rows.withColumn(out, fn(out).over(along_y().rowsBetween(-half, half)))


def fill_strict(binary: DataFrame, max_gap: int = 25, local: int = 15) -> DataFrame:
    """Black pixels between white ones of one row or column become white; the grid ends at its border."""
    s = _sides(binary, min(max_gap, local))
    inner = (F.col("left") & F.col("right")) | (F.col("up") & F.col("down"))
    return s.withColumn("v", F.when((F.col("v") == 0) & inner, 255).otherwise(F.col("v")).cast("long")).drop("left", "right", "up", "down")


def fill_relaxed(binary: DataFrame, window: int = 15, share: float = 0.7) -> DataFrame:
    """Black pixels with a white share of their clipped window, themselves left out, over `share` become white."""
    one = binary.withColumns({"_w": F.when(F.col("v") > 0, 1).otherwise(0), "_n": F.lit(1)})
    for name in ("_w", "_n"):
        one = _clipped(one, name, window // 2, F.sum, name)
    near = F.try_divide("_w", F.col("_n") - 1) > share
    return one.withColumn("v", F.when((F.col("v") == 0) & near, 255).otherwise(F.col("v")).cast("long")).drop("_w", "_n")


def fill_dense(binary: DataFrame, max_gap: int = 25, local: int = 15, share: float = 0.4, edge: int = 100) -> DataFrame:
    """Black pixels with a mean local density of `share` or more, white in three of four directions, and no Sobel
    magnitude over `edge` in their clipped window become white."""
    dense = density(binary, local)
    s = _sides(dense, min(max_gap, local))
    g = sobel(s).withColumn("_m", F.sqrt((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).cast("double")))
    g = _clipped(g, "_m", 1, F.max, "_m")
    sides = sum((F.col(c).cast("int") for c in ("right", "up", "down")), F.col("left").cast("int"))
    inner = (F.col("density") >= share) & (sides >= 3) & (F.col("_m") <= edge)
    return g.withColumn("v", F.when((F.col("v") == 0) & inner, 255).otherwise(F.col("v")).cast("long")).drop("left", "right", "up", "down", "gx", "gy", "_m", "hits", "density")


def meaningful_borders(binary: DataFrame, sensitivity: float = 0.5) -> DataFrame:
    """Sobel magnitude over its image's maximum, over sensitivity / 2; closed, then dilated twice."""
    g = sobel(binary).withColumn("m", F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    top = g.groupBy("image_id").agg(F.max("m").alias("top"))
    g = g.join(top, "image_id").withColumn("v", F.when((F.col("top") > 0) & (F.sqrt("m") > F.sqrt("top") * F.lit(sensitivity * 0.5)), 255).otherwise(0).cast("long")).drop("m", "top", "gx", "gy")
    return dilate(close(g, 3), 5)


def protect_borders(binary: DataFrame, borders: DataFrame, k: int = 15) -> DataFrame:
    """Black pixels of the k x k closing outside of the border mask become white."""
    closed = close(binary, k).select("image_id", "y", "x", F.col("v").alias("closed"))
    mask = borders.select("image_id", "y", "x", F.col("v").alias("border"))
    both = binary.join(closed, ["image_id", "y", "x"]).join(mask, ["image_id", "y", "x"], "left")
    return both.withColumn("v", F.when((F.col("v") == 0) & (F.col("closed") > 0) & (F.coalesce("border", F.lit(0)) == 0), 255).otherwise(F.col("v")).cast("long")).drop("closed", "border")


def bilateral(pixels: DataFrame, sigma_value: float = 10.0, sigma_space: float = 10.0) -> DataFrame:
    """(image_id, y, x, r, g, b): edge-preserving blur of diameter 3: each pixel and its four neighbours, weighted by distance and
    by the sum of the channels' differences; mirrored borders, truncated to integers."""
    rows = pixels.select("image_id", "y", "x", *"rgb")
    rows = rows.withColumns({f"{side}{c}": reflected(c, step, window) for window, names in ((along_x(), "lw"), (along_y(), "ue")) for side, step in zip(names, (-1, 1), strict=True) for c in "rgb"})
    apart = {side: sum((F.abs(F.col(f"{side}{c}") - F.col(c)) for c in "gb"), F.abs(F.col(f"{side}r") - F.col("r"))) for side in "lwue"}
    weight = {side: F.exp(-F.pow(d.cast("double"), 2) / (2 * sigma_value**2) - 1 / (2 * sigma_space**2)) for side, d in apart.items()}
    rows = rows.withColumns({f"_{side}": w for side, w in weight.items()})
    total = sum((F.col(f"_{side}") for side in "lwue"), F.lit(1.0))
    mixed = lambda c: F.floor(F.round(sum((F.col(f"_{side}") * F.col(f"{side}{c}") for side in "lwue"), F.col(c)) / total, 6)).cast("long")
    return rows.select("image_id", "y", "x", *(mixed(c).alias(c) for c in "rgb"))
