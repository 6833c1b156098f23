"""Edge thresholds, Canny, and the search for the best thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from ..functions.durable import durable
from . import components as cc
from . import grid

KEY = ["image_id", "y", "x"]
METHODS = ("otsu", "percentile", "gradient", "hybrid")
SENSITIVITIES = (0.5, 0.7, 1.0, 1.3, 1.5)


def gradient(gray: DataFrame, value: str = "v") -> DataFrame:
    """gray with gx, gy and mag, the root of their squares' sum."""
    return grid.sobel(gray, value).withColumn("mag", F.sqrt((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).cast("double")))


def otsu(gray: DataFrame) -> DataFrame:
    """(image_id, t): the level of the largest between-class variance; the lowest on ties."""
    hist = gray.groupBy("image_id", F.col("v").alias("level")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("image_id").orderBy("level")
    whole = Window.partitionBy("image_id")
    h = hist.select("image_id", "level", F.sum("n").over(upto).alias("w0"), F.sum(F.col("n") * F.col("level")).over(upto).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col("level")).over(whole).alias("s"))
    # the between-class variance times the pixel number squared: (s0 w - s w0)^2 / (w0 (w - w0))
    spread = F.when(F.col("w") > F.col("w0"), F.pow((F.col("s0") * F.col("w") - F.col("s") * F.col("w0")).cast("double"), 2) / (F.col("w0") * (F.col("w") - F.col("w0"))).cast("double")).otherwise(0.0)
    return h.withColumn("spread", F.round(spread, 3)).groupBy("image_id").agg(F.max_by("level", F.struct("spread", -F.col("level"))).alias("t"))


def _clamped(low: Column, high: Column, sensitivity: Column) -> tuple[Column, Column]:
    """Scaled, truncated, low in 10..200, high at least low + 10 and at most 255."""
    lo = color.clip((low * sensitivity).cast("long"), 10, 200)
    return lo, F.least(F.lit(255), F.greatest((high * sensitivity).cast("long"), lo + 10))


def thresholds(gray: DataFrame) -> DataFrame:
    """(image_id, method, low, high): unscaled thresholds of every method."""
    g = gradient(gray)
    stats = g.groupBy("image_id").agg(
        F.percentile(F.when(F.col("mag") > 0, F.col("mag")), F.array(F.lit(0.7), F.lit(0.9))).alias("p"),
        F.avg("mag").alias("mean"),
        F.stddev_pop("mag").alias("dev"),
        F.percentile("v", F.lit(0.5)).alias("median"),
    )
    s = stats.join(otsu(gray), "image_id")
    one = lambda name, low, high: F.struct(F.lit(name).alias("method"), low.cast("double").alias("low"), high.cast("double").alias("high"))
    t, mean, dev = F.col("t").cast("double"), F.col("mean"), F.col("dev")
    rows = F.array(
        one("otsu", t * 0.5, t * 1.5),
        one("percentile", F.coalesce(F.col("p")[0], F.lit(50.0)), F.coalesce(F.col("p")[1], F.lit(150.0))),
        one("gradient", mean - dev * 0.5, mean + dev * 0.5),
        one("hybrid", (t * 0.5 + mean * 0.5) / 2, (t * 1.5 + mean) / 2),
        one("fixed", F.lit(50.0), F.lit(150.0)),
    )
    return s.select("image_id", F.inline(rows))


def scaled(limits: DataFrame, sensitivity: float = 1.0) -> DataFrame:
    """(image_id, method, low, high) in integers, for one sensitivity."""
    lo, hi = _clamped(F.col("low"), F.col("high"), F.lit(sensitivity))
    return limits.select("image_id", "method", lo.alias("low"), hi.alias("high"))


def suggest(density: DataFrame, edges: DataFrame) -> DataFrame:
    """(image_id, mean, median, p70) of the density at edge pixels; 0.1 without any."""
    met = edges.select(*KEY, "v").join(density.select(*KEY, "density"), KEY)
    at = F.when(F.col("v") > 0, F.col("density"))
    return met.groupBy("image_id").agg(F.coalesce(F.avg(at), F.lit(0.1)).alias("mean"), F.coalesce(F.percentile(at, F.lit(0.5)), F.lit(0.1)).alias("median"), F.coalesce(F.percentile(at, F.lit(0.7)), F.lit(0.1)).alias("p70"))


def strongest(pixels: DataFrame) -> DataFrame:
    """(image_id, y, x, gx, gy): of each pixel the gradient of the channel with the largest L1 norm; the first on ties."""
    rows = pixels.select(*KEY, *"rgb")
    sides = {c: (grid.reflected(c, -1, grid.along_x()), grid.reflected(c, 1, grid.along_x())) for c in "rgb"}
    rows = rows.withColumns({f"d{c}": b - a for c, (a, b) in sides.items()} | {f"s{c}": a + F.col(c) * 2 + b for c, (a, b) in sides.items()})
    up, down = (lambda c: grid.reflected(c, -1, grid.along_y())), (lambda c: grid.reflected(c, 1, grid.along_y()))
    rows = rows.withColumns({f"x{c}": up(f"d{c}") + F.col(f"d{c}") * 2 + down(f"d{c}") for c in "rgb"} | {f"y{c}": down(f"s{c}") - up(f"s{c}") for c in "rgb"})
    norm = {c: F.abs(f"x{c}") + F.abs(f"y{c}") for c in "rgb"}
    pick = lambda k: F.when((norm["r"] >= norm["g"]) & (norm["r"] >= norm["b"]), F.col(f"{k}r")).when(norm["g"] >= norm["b"], F.col(f"{k}g")).otherwise(F.col(f"{k}b"))
    return rows.select(*KEY, pick("x").alias("gx"), pick("y").alias("gy"))


def suppressed(gray: DataFrame) -> DataFrame:
    """`thinned` of a gray image's gradient."""
    return thinned(grid.sobel(gray))


def thinned(gradients: DataFrame) -> DataFrame:
    """(image_id, y, x, m): L1 gradient where it is a maximum across its direction, else 0; ties go to the first side."""
    g = gradients.select(*KEY, "gx", "gy", (F.abs("gx") + F.abs("gy")).alias("m"))
    ax, ay = F.abs("gx"), F.abs("gy")
    flat, steep = ay * 1000 < ax * 414, ay * 1000 > ax * 2414
    same = (F.col("gx") * F.col("gy")) >= 0
    # neighbours along x by a window, along y and the diagonals by windows over columns of shifted values
    g = g.withColumns({"l": F.lag("m").over(grid.along_x()), "r": F.lead("m").over(grid.along_x())})
    up, down = (lambda c: F.coalesce(F.lag(c).over(grid.along_y()), F.lit(0))), (lambda c: F.coalesce(F.lead(c).over(grid.along_y()), F.lit(0)))
    g = g.withColumns({"u": up("m"), "d": down("m"), "ul": up("l"), "ur": up("r"), "dl": down("l"), "dr": down("r")})
    a = F.when(flat, F.coalesce("l", F.lit(0))).when(steep, F.col("u")).when(same, F.col("ul")).otherwise(F.col("ur"))
    b = F.when(flat, F.coalesce("r", F.lit(0))).when(steep, F.col("d")).when(same, F.col("dr")).otherwise(F.col("dl"))
    return g.select(*KEY, F.when((F.col("m") > a) & (F.col("m") >= b), F.col("m")).otherwise(0).cast("long").alias("m"))


def hysteresis(maxima: DataFrame, limits: DataFrame) -> DataFrame:
    """(image_id, y, x, v): weak components (over low) that hold a strong pixel (over high) are edges.

    limits: (image_id, low, high).
    """
    known = maxima.join(limits.select("image_id", "low", "high"), "image_id")
    weak = known.where("m > low")
    labels = cc.label(weak)
    strong = labels.join(known.where("m > high").select(*KEY), KEY, "left_semi").select("image_id", "label").distinct()
    edges = labels.join(strong, ["image_id", "label"], "left_semi").select(*KEY, F.lit(255).cast("long").alias("v"))
    return maxima.select(*KEY).join(edges, KEY, "left").withColumn("v", F.coalesce("v", F.lit(0).cast("long")))


def canny(gray: DataFrame, limits: DataFrame) -> DataFrame:
    return hysteresis(suppressed(gray), limits)


def quality(edges: DataFrame, gray: DataFrame) -> DataFrame:
    """(image_id, score): mean 8-connected component size times the deviation of gray at edges; 0 without edges."""
    labels = cc.label(edges.where("v > 0"))
    sizes = labels.groupBy("image_id").agg((F.count("*") / F.countDistinct("label")).alias("mean"))
    dev = labels.join(gray.select(*KEY, F.col("v").alias("gray")), KEY).groupBy("image_id").agg(F.stddev_pop("gray").alias("dev"))
    images = edges.select("image_id").distinct()
    return images.join(sizes, "image_id", "left").join(dev, "image_id", "left").select("image_id", F.coalesce(F.col("mean") * F.col("dev"), F.lit(0.0)).alias("score"))


def canny_rgb(pixels: DataFrame, limits: DataFrame) -> DataFrame:
    """Canny on colour pixels: every pixel's strongest channel counts."""
    return hysteresis(thinned(strongest(pixels)), limits)


def _candidates(gray: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Thresholds (image_id, ord, low, high) of every method and sensitivity, the edge pixels (image_id, ord, label, y, x)
    of each, and (image_id, ord) of the best. All candidates are labelled in one job: a candidate is an image of its own."""
    limits = thresholds(gray).where("method <> 'fixed'")
    grid_ = gray.sparkSession.createDataFrame([(i * len(SENSITIVITIES) + j, m, s) for i, m in enumerate(METHODS) for j, s in enumerate(SENSITIVITIES)], "ord int, method string, sens double")
    lo, hi = _clamped(F.col("low"), F.col("high"), F.col("sens"))
    tries = limits.join(F.broadcast(grid_), "method").select("image_id", "ord", lo.alias("low"), hi.alias("high")).transform(durable)
    maxima = suppressed(gray).where("m > 10").transform(durable)
    # the least thresholds come first in the classes of equal low ones: each is labelled once
    lows = tries.select("image_id", "low").distinct()
    weak = maxima.join(lows, "image_id").where("m > low").select("image_id", "low", F.xxhash64("image_id", "low").alias("own"), "y", "x", "m")
    labels = cc.label(weak.select(F.col("own").alias("image_id"), "y", "x")).withColumnRenamed("image_id", "own").join(weak, ["own", "y", "x"]).select("image_id", "low", "label", "y", "x", "m").transform(durable)
    peaks = labels.groupBy("image_id", "low", "label").agg(F.max("m").alias("peak"))
    strong = tries.join(peaks, ["image_id", "low"]).where("peak > high").select("image_id", "ord", "low", "label")
    kept = labels.join(strong, ["image_id", "low", "label"]).select("image_id", "ord", "label", "y", "x").transform(durable)
    valued = kept.join(gray.select(*KEY, "v"), KEY)
    scored = valued.groupBy("image_id", "ord").agg((F.count("*") / F.countDistinct("label") * F.stddev_pop("v")).alias("score"))
    win = scored.groupBy("image_id").agg(F.max_by("ord", F.struct(F.round("score", 9), -F.col("ord"))).alias("ord"))
    return tries, kept, win


def best(gray: DataFrame) -> DataFrame:
    """(image_id, y, x, v): the edge map of the method and sensitivity with the best quality; the first wins ties."""
    _, kept, win = _candidates(gray)
    chosen = kept.join(win, ["image_id", "ord"], "left_semi").select(*KEY, F.lit(255).cast("long").alias("v"))
    return gray.select(*KEY).join(chosen, KEY, "left").withColumn("v", F.coalesce("v", F.lit(0).cast("long")))


def best_limits(gray: DataFrame) -> DataFrame:
    """(image_id, low, high): the thresholds of that map; images without an edge fall back to 50 and 150."""
    tries, _, win = _candidates(gray)
    found = tries.join(win, ["image_id", "ord"]).select("image_id", "low", "high")
    return gray.select("image_id").distinct().join(found, "image_id", "left").select("image_id", F.coalesce("low", F.lit(50)).alias("low"), F.coalesce("high", F.lit(150)).alias("high"))


def fast_thresholds(gray: DataFrame) -> DataFrame:
    """(image_id, low, high): means of p25 * .7, p75 * 1.3 of gray and of the 10 and 90 % places of the L1 gradient."""
    p = gray.groupBy("image_id").agg((F.percentile("v", F.lit(0.25)) * 0.7).alias("a"), (F.percentile("v", F.lit(0.75)) * 1.3).alias("b"))
    g = grid.sobel(gray).select("image_id", (F.abs("gx") + F.abs("gy")).alias("m")).where("m > 0")
    w = Window.partitionBy("image_id")
    ranked = g.groupBy("image_id", "m").agg(F.count("*").alias("c")).withColumns({"upto": F.sum("c").over(w.orderBy("m")), "n": F.sum("c").over(w)})
    place = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col("m")))
    q = ranked.groupBy("image_id").agg(F.when(F.max("n") > 100, place(0.1)).otherwise(50).cast("double").alias("c"), F.when(F.max("n") > 100, place(0.9)).otherwise(150).cast("double").alias("d"))
    return p.join(q, "image_id").select("image_id", ((F.col("a") + F.col("c")) / 2).alias("low"), ((F.col("b") + F.col("d")) / 2).alias("high"))
