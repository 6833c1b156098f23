"""Distortion metrics, outlier-aware metrics, SSIM, ratings and corpus summaries.

Pairs are (image_id, y, x, r, g, b, dr, dg, db). Sums stay in integers up to one division.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from .grid import along_x, along_y

PIXEL = ["image_id", "y", "x"]


def pair(original: DataFrame, decoded: DataFrame) -> DataFrame:
    return original.select(*PIXEL, "r", "g", "b").join(decoded.select(*PIXEL, "dr", "dg", "db"), PIXEL)


def _square(c: str):
    return (F.col(c) - F.col(f"d{c}")) * (F.col(c) - F.col(f"d{c}"))


def metrics(pairs: DataFrame) -> DataFrame:
    """(image_id, pixels, mse, mse_r, mse_g, mse_b, rmse, mae, max_error, psnr)."""
    sums = pairs.groupBy("image_id").agg(
        F.count("*").alias("pixels"),
        *(F.sum(_square(c)).alias(f"s{c}") for c in "rgb"),
        F.sum(F.abs(F.col("r") - F.col("dr")) + F.abs(F.col("g") - F.col("dg")) + F.abs(F.col("b") - F.col("db"))).alias("sa"),
        F.max(F.greatest(*(F.abs(F.col(c) - F.col(f"d{c}")) for c in "rgb"))).alias("max_error"),
    )
    mse = (F.col("sr") + F.col("sg") + F.col("sb")) / (F.col("pixels") * 3)
    out = sums.withColumn("mse", mse).withColumns({f"mse_{c}": F.col(f"s{c}") / F.col("pixels") for c in "rgb"})
    return out.withColumns({"rmse": F.sqrt("mse"), "mae": F.col("sa") / (F.col("pixels") * 3), "psnr": color.psnr(F.col("mse"))}).select("image_id", "pixels", "mse", "mse_r", "mse_g", "mse_b", "rmse", "mae", "max_error", "psnr")


def differences(pairs: DataFrame) -> DataFrame:
    """(image_id, y, x, absolute, squared, weighted): differences over their image's maximum; 0 where that is 0."""
    a = sum((F.abs(F.col(c) - F.col(f"d{c}")) for c in "gb"), F.abs(F.col("r") - F.col("dr")))
    s = sum((_square(c) for c in "gb"), _square("r"))
    w = F.abs(F.col("r") - F.col("dr")) * 299 + F.abs(F.col("g") - F.col("dg")) * 587 + F.abs(F.col("b") - F.col("db")) * 114
    raw = pairs.select(*PIXEL, a.alias("a"), s.alias("s"), w.alias("w"))
    top = raw.groupBy("image_id").agg(*(F.max(c).alias(f"m{c}") for c in "asw"))
    met = raw.join(top, "image_id")
    return met.select(*PIXEL, *(F.coalesce(F.try_divide(c, f"m{c}"), F.lit(0.0)).alias(n) for c, n in (("a", "absolute"), ("s", "squared"), ("w", "weighted"))))


def pixel_errors(pairs: DataFrame) -> DataFrame:
    """pairs with e, the largest channel error."""
    return pairs.withColumn("e", F.greatest(*(F.abs(F.col(c) - F.col(f"d{c}")) for c in "rgb")))


def adaptive(pairs: DataFrame) -> DataFrame:
    """Per image: error statistics, the bounds and shares of four outlier rules, the rule that is chosen, and PSNR without its outliers.

    Rules in order: iqr (Q3 + 2.5 IQR), zscore (|z| > 3), percentile (> p99), adaptive (mean > 1.5 median ? median + 3 dev :
    mean + 2.5 dev). The first whose share is in 0.1 to 10 % is taken, else adaptive.
    """
    errors = pixel_errors(pairs).withColumn("se", _square("r") + _square("g") + _square("b"))
    s = errors.groupBy("image_id").agg(
        F.count("*").alias("pixels"), F.min("e").alias("min_e"), F.max("e").alias("max_e"), F.avg("e").alias("mean_e"), F.stddev_pop("e").alias("std_e"),
        F.percentile("e", F.array(*(F.lit(p) for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)))).alias("p"),
    )
    s = s.withColumns({n: F.col("p")[k] for k, n in enumerate(("p25", "median_e", "p75", "p90", "p95", "p99"))}).drop("p")
    s = s.withColumns(
        {
            "t_iqr": F.col("p75") + (F.col("p75") - F.col("p25")) * 2.5,
            "t_adaptive": F.when(F.col("mean_e") > F.col("median_e") * 1.5, F.col("median_e") + F.col("std_e") * 3).otherwise(F.col("mean_e") + F.col("std_e") * 2.5),
        }
    )
    met = errors.join(s, "image_id")
    rules = {
        "iqr": F.col("e") > F.col("t_iqr"),
        "zscore": F.coalesce(F.abs(F.try_divide(F.col("e") - F.col("mean_e"), F.col("std_e"))) > 3, F.lit(False)),
        "percentile": F.col("e") > F.col("p99"),
        "adaptive": F.col("e") > F.col("t_adaptive"),
    }
    counted = met.groupBy("image_id").agg(*(F.sum(r.cast("long")).alias(f"n_{k}") for k, r in rules.items()), *(F.sum(F.when(r, F.col("se")).otherwise(0)).alias(f"s_{k}") for k, r in rules.items()), F.sum("se").alias("s_all"))
    out = s.join(counted, "image_id")
    share = lambda k: F.col(f"n_{k}") * 100 / F.col("pixels")
    chosen = F.lit("adaptive")
    for k in ("percentile", "zscore", "iqr"):
        chosen = F.when((share(k) >= 0.1) & (share(k) <= 10), F.lit(k)).otherwise(chosen)
    out = out.withColumn("rule", chosen)
    pick = lambda p: F.coalesce(*(F.when(F.col("rule") == k, F.col(f"{p}_{k}")) for k in rules))
    out = out.withColumns({"outliers": pick("n"), "outlier_se": pick("s")})
    clean = (F.col("s_all") - F.col("outlier_se")) / ((F.col("pixels") - F.col("outliers")) * 3)
    return out.withColumns({"psnr_all": color.psnr(F.col("s_all") / (F.col("pixels") * 3)), "psnr_clean": color.psnr(clean)}).drop("s_all", "outlier_se", *(f"s_{k}" for k in rules))


def percentile_scopes(pairs: DataFrame) -> DataFrame:
    """(image_id, scope, pixels, mse, psnr) over pixels whose error is at most p99, p95, p90, p75, and over all."""
    errors = pixel_errors(pairs).select("image_id", "e", (_square("r") + _square("g") + _square("b")).alias("se"))
    p = errors.groupBy("image_id").agg(F.percentile("e", F.array(*(F.lit(q) for q in (0.99, 0.95, 0.9, 0.75)))).alias("p"))
    names = ("percentile_99", "percentile_95", "percentile_90", "percentile_75")
    limits = p.select("image_id", F.inline(F.array(*(F.struct(F.lit(n).alias("scope"), F.col("p")[k].alias("limit")) for k, n in enumerate(names)), F.struct(F.lit("all").alias("scope"), F.lit(1e9).alias("limit")))))
    met = errors.join(limits, "image_id").where("e <= limit").groupBy("image_id", "scope").agg(F.count("*").alias("pixels"), F.sum("se").alias("s"))
    return met.withColumn("mse", F.col("s") / (F.col("pixels") * 3)).withColumn("psnr", color.psnr(F.col("mse"))).drop("s")


def histogram(pairs: DataFrame, bins: int = 50) -> DataFrame:
    """(image_id, bin, n): equal bins from the least to the largest error; the last one is closed."""
    errors = pixel_errors(pairs).select("image_id", "e")
    ends = errors.groupBy("image_id").agg(F.min("e").alias("low"), F.max("e").alias("high"))
    at = F.when(F.col("high") > F.col("low"), F.least(F.lit(bins - 1), F.floor((F.col("e") - F.col("low")) * bins / (F.col("high") - F.col("low"))))).otherwise(0)
    return errors.join(ends, "image_id").groupBy("image_id", at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def ssim(pairs: DataFrame, win: int = 7) -> DataFrame:
    """(image_id, ssim): mean structural similarity over win x win windows that lie inside, mean of the channels; sample
    covariances, range 255. Window sums are integers; images smaller than a window have none."""
    half = win // 2
    moments = {}
    for c in "rgb":
        a, b = F.col(c), F.col(f"d{c}")
        moments |= {f"{c}x": a, f"{c}y": b, f"{c}xx": a * a, f"{c}yy": b * b, f"{c}xy": a * b}
    grid = pairs.select(*PIXEL, *(v.alias(k) for k, v in moments.items()))
    wx, wy = along_x().rowsBetween(-half, half), along_y().rowsBetween(-half, half)
    rows = grid.select(*PIXEL, F.count("*").over(wx).alias("nx"), *(F.sum(k).over(wx).alias(k) for k in moments)).where(F.col("nx") == win)
    full = rows.select("image_id", F.count("*").over(wy).alias("ny"), *(F.sum(k).over(wy).alias(k) for k in moments)).where(F.col("ny") == win)
    n, c1, c2 = win * win, (0.01 * 255) ** 2, (0.03 * 255) ** 2
    total = None
    for c in "rgb":
        ux, uy = F.col(f"{c}x") / n, F.col(f"{c}y") / n
        cov = lambda k, p, q: (F.col(k) * n - F.col(p) * F.col(q)) / (n * (n - 1))
        vx, vy, vxy = cov(f"{c}xx", f"{c}x", f"{c}x"), cov(f"{c}yy", f"{c}y", f"{c}y"), cov(f"{c}xy", f"{c}x", f"{c}y")
        one = ((ux * uy * 2 + c1) * (vxy * 2 + c2)) / ((ux * ux + uy * uy + c1) * (vx + vy + c2))
        total = one if total is None else total + one
    return full.groupBy("image_id").agg(F.avg(total / 3).alias("ssim"))


def ssim_clean(pairs: DataFrame, win: int = 7) -> DataFrame:
    """(image_id, ssim) with the chosen rule's outliers set to gray 128 on both sides."""
    found = adaptive(pairs)
    bound = F.when(F.col("rule") == "iqr", F.col("t_iqr")).when(F.col("rule") == "percentile", F.col("p99")).when(F.col("rule") == "zscore", F.col("mean_e") + F.col("std_e") * 3).otherwise(F.col("t_adaptive"))
    met = pixel_errors(pairs).join(found.select("image_id", bound.alias("bound")), "image_id")
    gray = F.lit(128).cast("long")
    return ssim(met.withColumns({c: F.when(F.col("e") > F.col("bound"), gray).otherwise(F.col(c)) for x in "rgb" for c in (x, f"d{x}")}), win)


def rated(m: DataFrame) -> DataFrame:
    """metrics with both rating scales."""
    return m.withColumns({"rating": color.rating(F.col("psnr")), "rating_five": color.rating_five(F.col("psnr"))})


def summary(m: DataFrame) -> DataFrame:
    """(metric, low, high, mean, std) of psnr, mse and mae over images; sample deviation."""
    long = m.select(F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in ("psnr", "mse", "mae")))))
    return long.groupBy("metric").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def buckets(m: DataFrame) -> DataFrame:
    """(bucket, images) of the five-level scale."""
    return m.groupBy(color.rating_five(F.col("psnr")).alias("bucket")).agg(F.count("*").alias("images"))


def extremes(m: DataFrame, k: int = 3) -> DataFrame:
    """(side, place, image_id, psnr): the k best and worst images."""
    best = m.select("image_id", "psnr").orderBy(F.desc("psnr"), "image_id").limit(k).withColumn("side", F.lit("best"))
    worst = m.select("image_id", "psnr").orderBy("psnr", "image_id").limit(k).withColumn("side", F.lit("worst"))
    order = F.when(F.col("side") == "best", -F.col("psnr")).otherwise(F.col("psnr"))
    return best.union(worst).select("side", F.row_number().over(Window.partitionBy("side").orderBy(order, "image_id")).cast("long").alias("place"), "image_id", "psnr")


def compare_codecs(sizes: DataFrame, m: DataFrame, pixels: DataFrame) -> DataFrame:
    """(image_id, codec, kilobytes, ratio, bpp, psnr) from sizes(image_id, codec, bytes) and metrics(image_id, codec, psnr)."""
    px = pixels.groupBy("image_id").agg(F.count("*").alias("pixels"))
    met = sizes.join(m, ["image_id", "codec"]).join(px, "image_id")
    return met.select("image_id", "codec", (F.col("bytes") / 1024).alias("kilobytes"), (F.col("pixels") * 3 / F.col("bytes")).alias("ratio"), (F.col("bytes") * 8 / F.col("pixels")).alias("bpp"), "psnr")


def with_average(m: DataFrame) -> DataFrame:
    """(image, psnr, mse, mae): every image and a row AVERAGE, in one rollup."""
    return m.rollup("image_id").agg(F.avg("psnr").alias("psnr"), F.avg("mse").alias("mse"), F.avg("mae").alias("mae")).select(F.coalesce(F.col("image_id").cast("string"), F.lit("AVERAGE")).alias("image"), "psnr", "mse", "mae")
