"""Ordered-sequence analytics of boundaries: arc length, curvature, division, splines, storage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _shape():
    return Window.partitionBy("shape_id").orderBy("seq")


def _upto():
    return _shape().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def arc_length(points: DataFrame) -> DataFrame:
    """points with step, the distance from the point before, and arc, its running sum."""
    dx, dy = F.col("px") - F.lag("px").over(_shape()), F.col("py") - F.lag("py").over(_shape())
    return points.withColumn("step", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))).withColumn("arc", F.sum("step").over(_upto()))


def divide(points: DataFrame, parts: int, overlap: int = 2) -> DataFrame:
    """(shape_id, part, seq, px, py): the closed ring cut at the points nearest to i / parts of its length (the first on
    ties); parts share cut points and `overlap` points to each side."""
    first = points.groupBy("shape_id").agg(F.min_by(F.struct("px", "py"), "seq").alias("f"), F.max("seq").alias("m"))
    ring = points.select("shape_id", "seq", "px", "py").union(first.select("shape_id", F.col("m") + 1, "f.px", "f.py"))
    at = arc_length(ring)
    total = at.groupBy("shape_id").agg(F.max("arc").alias("total"), F.max("seq").alias("last"))
    cuts = at.join(total, "shape_id").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(parts)))).groupBy("shape_id", "i", "last").agg(F.min_by("seq", F.struct(F.round(F.abs(F.col("arc") - F.col("total") * F.col("i") / parts), 9), "seq")).alias("cut"))
    w = Window.partitionBy("shape_id").orderBy("i")
    spans = cuts.withColumn("to", F.lead("cut").over(w)).where("to is not null").select("shape_id", F.col("i").cast("long").alias("part"), F.greatest(F.lit(0), F.col("cut") - overlap).alias("lo"), F.least("last", F.col("to") + overlap).alias("hi"))
    return spans.join(ring, "shape_id").where("seq >= lo and seq <= hi").select("shape_id", "part", "seq", "px", "py")


def curvature(points: DataFrame) -> DataFrame:
    """points with angle, the turn at each inner point in radians; 0 at the ends and at repeated points."""
    ax, ay = F.col("px") - F.lag("px").over(_shape()), F.col("py") - F.lag("py").over(_shape())
    bx, by = F.lead("px").over(_shape()) - F.col("px"), F.lead("py").over(_shape()) - F.col("py")
    v = points.withColumns({"ax": ax, "ay": ay, "bx": bx, "by": by})
    norm = F.sqrt((F.col("ax") ** 2 + F.col("ay") ** 2) * (F.col("bx") ** 2 + F.col("by") ** 2))
    cosine = F.try_divide(F.col("ax") * F.col("bx") + F.col("ay") * F.col("by"), norm)
    return v.withColumn("angle", F.coalesce(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))), F.lit(0.0))).drop("ax", "ay", "bx", "by")


def key_points(points: DataFrame, k: int) -> DataFrame:
    """Both ends and the k - 2 points of largest turn (ties to the first), in order."""
    at = curvature(points).withColumn("angle", F.round("angle", 9))
    n = Window.partitionBy("shape_id")
    ranked = at.withColumns({"lo": F.min("seq").over(n), "hi": F.max("seq").over(n)}).withColumn("end", (F.col("seq") == F.col("lo")) | (F.col("seq") == F.col("hi")))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("shape_id").orderBy(F.desc("end"), F.desc("angle"), "seq")))
    return ranked.where(F.col("rank") <= k).select("shape_id", "seq", "px", "py", "angle")


def deduped(points: DataFrame, decimals: int = 3, tolerance: float = 1e-6) -> DataFrame:
    """(shape_id, seq, px, py): points that repeat the one before go, the rest are rounded half to even, and repeats go again."""
    far = lambda c, eps: F.abs(F.col(c) - F.lag(c).over(_shape())) > eps
    once = points.withColumn("keep", F.coalesce(far("px", tolerance) | far("py", tolerance), F.lit(True))).where("keep").drop("keep")
    short = once.withColumns({c: F.bround(c, decimals) for c in ("px", "py")})
    return short.withColumn("keep", F.coalesce((F.lag("px").over(_shape()) != F.col("px")) | (F.lag("py").over(_shape()) != F.col("py")), F.lit(True))).where("keep").select("shape_id", "seq", "px", "py")


def combine(parts: DataFrame) -> DataFrame:
    """(shape_id, part, seq, px, py) without the first max(1, n / 5) points of every part but the first: parts overlap there."""
    w = Window.partitionBy("shape_id", "part")
    ranked = parts.withColumns({"n": F.count("*").over(w), "k": F.row_number().over(w.orderBy("seq"))})
    return ranked.where((F.col("part") == 0) | (F.col("k") > F.greatest(F.lit(1), F.floor(F.col("n") / 5)))).drop("n", "k")


def resampled(points: DataFrame, many: int) -> DataFrame:
    """(shape_id, seq, px, py): `many` points at even places of the index, on the lines between neighbours."""
    n = points.groupBy("shape_id").agg((F.count("*") - 1).alias("last"))
    place = n.withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))).withColumn("at", F.col("seq") * F.col("last") / (many - 1))
    numbered = points.withColumn("i", F.row_number().over(_shape()) - 1).withColumns({"qx": F.coalesce(F.lead("px").over(_shape()), "px"), "qy": F.coalesce(F.lead("py").over(_shape()), "py")})
    met = place.withColumn("i", F.floor("at").cast("int")).join(numbered.select("shape_id", "i", "px", "py", "qx", "qy"), ["shape_id", "i"])
    share = F.col("at") - F.col("i")
    return met.select("shape_id", "seq", (F.col("px") + (F.col("qx") - F.col("px")) * share).alias("px"), (F.col("py") + (F.col("qy") - F.col("py")) * share).alias("py"))


def storage(original: DataFrame, compact: DataFrame) -> DataFrame:
    """(shape_id, points, kept, bytes, ratio, bits_per_point): 8 bytes for a kept point against 16."""
    n, k = (df.groupBy("shape_id").agg(F.count("*").alias(name)) for df, name in ((original, "points"), (compact, "kept")))
    return n.join(k, "shape_id").select("shape_id", "points", "kept", (F.col("kept") * 8).alias("bytes"), (F.col("points") * 16 / (F.col("kept") * 8)).alias("ratio"), (F.col("kept") * 64 / F.col("points")).alias("bits_per_point"))


def cumulative_error(points: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """(shape_id, seq, error, total): distances of equal seq, and their running sum."""
    met = points.join(rebuilt.select("shape_id", "seq", F.col("px").alias("qx"), F.col("py").alias("qy")), ["shape_id", "seq"])
    e = met.select("shape_id", "seq", F.sqrt((F.col("px") - F.col("qx")) ** 2 + (F.col("py") - F.col("qy")) ** 2).alias("error"))
    return e.withColumn("total", F.sum("error").over(_upto()))


def error_summary(errors: DataFrame) -> DataFrame:
    """(shape_id, mean, std, high, p95, over): over counts errors of more than .001."""
    return errors.groupBy("shape_id").agg(F.avg("error").alias("mean"), F.stddev_pop("error").alias("std"), F.max("error").alias("high"), F.percentile("error", F.lit(0.95)).alias("p95"), F.count_if(F.col("error") > 0.001).alias("over"))


def tridiagonal(low: np.ndarray, mid: np.ndarray, up: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solves a tridiagonal system, a column of rhs each; low[0] and up[-1] are of no account."""
    n = len(mid)
    c, d = np.zeros(n), np.array(rhs, float)
    c[0], d[0] = up[0] / mid[0], d[0] / mid[0]
    for i in range(1, n):
        by = mid[i] - low[i] * c[i - 1]
        c[i] = up[i] / by
        d[i] = (d[i] - low[i] * d[i - 1]) / by
    for i in range(n - 2, -1, -1):
        d[i] -= c[i] * d[i + 1]
    return d


def natural_spline(t: np.ndarray, v: np.ndarray, at: np.ndarray, periodic: bool = False) -> np.ndarray:
    """A cubic spline through (t, v), natural or periodic, at the places asked for."""
    n = len(t)
    h = np.diff(t)
    slope = np.diff(v, axis=0) / h[:, None]
    m = np.zeros_like(v, dtype=float)  # second derivatives
    if periodic:  # the last point is the first: a cyclic system, by a rank-one correction
        rhs = 6 * (slope - np.roll(slope, 1, axis=0))
        low, mid, up = np.roll(h, 1), 2 * (np.roll(h, 1) + h), h.copy()
        corner, g = h[-1], -mid[0]
        mid[0], mid[-1] = mid[0] - g, mid[-1] - corner * corner / g
        u = np.zeros((n - 1, 1))
        u[0], u[-1] = g, corner
        found = tridiagonal(low, mid, up, np.hstack([rhs, u]))
        y, q = found[:, :-1], found[:, -1:]
        share = (y[:1] + y[-1:] * corner / g) / (1 + q[:1] + q[-1:] * corner / g)
        m[:-1] = y - q * share
        m[-1] = m[0]
    elif n > 2:
        m[1:-1] = tridiagonal(h[:-1], 2 * (h[:-1] + h[1:]), h[1:], 6 * np.diff(slope, axis=0))
    k = np.clip(np.searchsorted(t, at, side="right") - 1, 0, n - 2)
    u, w = (t[k + 1] - at)[:, None], (at - t[k])[:, None]
    hk = h[k][:, None]
    return (m[k] * u**3 + m[k + 1] * w**3) / (6 * hk) + (v[k] / hk - m[k] * hk / 6) * u + (v[k + 1] / hk - m[k + 1] * hk / 6) * w


def rebuild(keys: DataFrame, points: int = 200) -> DataFrame:
    """(shape_id, seq, px, py): a closed curve of `points` points through the key points; by lines under four of them."""

    def run(key, table):
        seq, x, y = (table.column(c).to_numpy() for c in ("seq", "px", "py"))
        order = np.argsort(seq, kind="stable")
        v = np.column_stack([x, y])[order]
        keep = np.append(True, (np.abs(np.diff(v, axis=0)) > 1e-9).any(axis=1))
        v = v[keep]
        if len(v) and not np.allclose(v[0], v[-1]):
            v = np.vstack([v, v[0]])
        if len(v) < 2:
            out = np.repeat(v, points, axis=0) if len(v) else np.zeros((0, 2))
        else:
            t = np.concatenate([[0], np.cumsum(np.sqrt((np.diff(v, axis=0) ** 2).sum(axis=1)))])
            at = np.linspace(0, t[-1], points)
            out = natural_spline(t, v, at, True) if len(v) >= 5 else np.column_stack([np.interp(at, t, v[:, i]) for i in range(2)])
        return pa.table([pa.array([key[0].as_py()] * len(out), pa.int64()), pa.array(np.arange(len(out))), pa.array(out[:, 0].copy()), pa.array(out[:, 1].copy())], names=["shape_id", "seq", "px", "py"])

    return keys.select("shape_id", "seq", "px", "py").groupBy("shape_id").applyInArrow(run, "shape_id long, seq long, px double, py double")


def compress(points: DataFrame, parts: int = 10, ratio: float = 0.3) -> DataFrame:
    """(shape_id, seq, px, py): the key points of every part, the parts' shared points once; end parts keep .8 of the ratio."""
    cut = divide(points, parts)
    n = cut.groupBy("shape_id", "part").agg(F.count("*").alias("n"))
    share = F.when((F.col("part") == 0) | (F.col("part") == parts - 1), ratio * 0.8).otherwise(ratio)
    wanted = n.withColumn("k", F.greatest(F.lit(4), F.floor(F.col("n") * share))).select("shape_id", "part", "k")
    each = cut.withColumn("home", F.col("shape_id")).withColumn("shape_id", F.struct("shape_id", "part"))
    at = curvature(each).withColumn("angle", F.round("angle", 9)).withColumn("part", F.col("shape_id.part"))
    w = Window.partitionBy("home", "part")
    at = at.withColumns({"lo": F.min("seq").over(w), "hi": F.max("seq").over(w)}).withColumn("end", (F.col("seq") == F.col("lo")) | (F.col("seq") == F.col("hi")))
    at = at.withColumn("rank", F.row_number().over(w.orderBy(F.desc("end"), F.desc("angle"), "seq"))).drop("shape_id").withColumnRenamed("home", "shape_id")
    return at.join(wanted, ["shape_id", "part"]).where("rank <= k").select("shape_id", "seq", "px", "py").distinct()
