"""Named queries over the derived pixel tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import color
from ..operators import boundary, codec, components, edges, enhance, grid, overlay, palette, quality, roi, segment
from ..sources import fixtures as fx
from . import sql as S
from .codec_plan import encode_images

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
PIXEL = ["image_id", "y", "x"]


def query(sql: str | None = None):
    """Register a query under its name; `sql` is the DuckDB text of the same result."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that engines that add in another order agree."""
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


def corpus_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.corpus(spark, sf_dir).select(*PIXEL, color.gray().alias("v"))


def mosaic_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.mosaic(spark, sf_dir).select(*PIXEL, color.gray().alias("v"))


def mosaic_white(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.white(fx.mosaic(spark, sf_dir)).drop("pid")


def corpus_white(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.white(fx.corpus(spark, sf_dir)).drop("pid")


def mosaic_labels(spark: SparkSession, sf_dir: str, eight: bool = True) -> DataFrame:
    return components.label(mosaic_white(spark, sf_dir).where("v > 0"), eight)


def corpus_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.corpus(spark, sf_dir)
    return p.selectExpr(*PIXEL, "r", "g", "b", *(f"cast(floor({c} / 16) as bigint) * 16 + 8 as d{c}" for c in "rgb"))


# scans, projections and filters


@query(S.CORPUS + "SELECT image_id, CAST(count(*) AS BIGINT) AS pixels, max(y) + 1 AS height, max(x) + 1 AS width, CAST(sum(r + g + b) AS BIGINT) AS total FROM f3 GROUP BY image_id")
def pixel_scan(spark, d):
    return fx.corpus(spark, d).groupBy("image_id").agg(F.count("*").alias("pixels"), (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.sum(F.expr("r + g + b")).alias("total"))


@query(S.CORPUS + "SELECT image_id, y, x, CAST(floor((r * 4899 + g * 9617 + b * 1868 + 8192) / 16384) AS BIGINT) AS gray, 299 * r + 587 * g + 114 * b AS luma, round((r * 0.2125 + g * 0.7154 + b * 0.0721) / 255, 6) AS gray_float FROM f3")
def gray_luma(spark, d):
    return fx.corpus(spark, d).select(*PIXEL, color.gray().alias("gray"), color.luma().alias("luma"), F.round(color.gray_float(), 6).alias("gray_float"))


@query(S.CORPUS + S.LAB)
def lab_color(spark, d):
    l_, a_, b_ = color.lab()
    return rounded(fx.corpus(spark, d).select(*PIXEL, l_.alias("l"), a_.alias("a"), b_.alias("bb")), 4)


@query(S.MOSAIC + S.box(3) + "SELECT image_id, y, x, CAST(CASE WHEN hits > 4 THEN 255 ELSE 0 END AS BIGINT) AS v FROM box")
def density_filter(spark, d):
    return grid.density(mosaic_white(spark, d), 3).select(*PIXEL, F.when(F.col("hits") > 4, 255).otherwise(0).cast("long").alias("v"))


@query(S.MOSAIC + S.diamond(3) + "SELECT image_id, y, x, near_white AS roi, near_black AS nonroi FROM dia")
def mask_split(spark, d):
    return roi.split_masks(mosaic_white(spark, d), 3)


@query(S.MOSAIC + "SELECT image_id, y, x, v > 0 AS roi, v <= 0 AS nonroi FROM f4")
def mask_split_disjoint(spark, d):
    return roi.split_disjoint(mosaic_white(spark, d))


# palettes


@query(S.CORPUS + S.PALETTE + "SELECT image_id, idx, r, g, b FROM pal")
def palette_distinct(spark, d):
    return palette.distinct(fx.coarse(fx.corpus(spark, d)))


@query(S.CORPUS + S.PALETTE + "SELECT image_id, y, x, idx FROM q3 JOIN pal USING (image_id, r, g, b)")
def palette_indices(spark, d):
    p = fx.coarse(fx.corpus(spark, d))
    return palette.indices(p, palette.distinct(p))


@query(S.CORPUS + S.PALETTE + "SELECT image_id, y, x, r, g, b FROM q3")
def decode_gather(spark, d):
    p = fx.coarse(fx.corpus(spark, d))
    colours = palette.distinct(p)
    return palette.gather(palette.indices(p, colours), colours)


@query(S.CORPUS + S.PALETTE + "SELECT image_id, CAST(count(*) AS BIGINT) AS n, CAST(102.4 AS DOUBLE) AS eps, CAST(greatest(1, ceil((count(*) - count(*) * CAST(0.2 AS DOUBLE)) / 20)) AS BIGINT) AS most, 1 AS min_samples FROM pal GROUP BY image_id")
def clustering_params(spark, d):
    counts = palette.distinct(fx.coarse(fx.corpus(spark, d))).groupBy("image_id").agg(F.count("*").alias("n"))
    return rounded(palette.params(counts, 20))


@query(S.MOSAIC + S.PALETTE_ONE + "SELECT image_id, CAST(floor(idx / 8) AS BIGINT) AS cluster, CAST(count(*) AS BIGINT) AS n, CAST(floor(sum(r) / count(*)) AS BIGINT) AS r, CAST(floor(sum(g) / count(*)) AS BIGINT) AS g, CAST(floor(sum(b) / count(*)) AS BIGINT) AS b FROM pal GROUP BY image_id, floor(idx / 8)")
def cluster_mean_floor(spark, d):
    return palette.cluster_means(palette.distinct(fx.coarse(fx.mosaic(spark, d))).withColumn("cluster", F.floor(F.col("idx") / 8)))


@query(S.MOSAIC + S.PALETTE_ONE + S.LUMA_SPLIT)
def luma_split(spark, d):
    return palette.luma_split(palette.distinct(fx.coarse(fx.mosaic(spark, d))).withColumn("cluster", F.col("idx") % 3), 20)


@query(S.CORPUS + S.PALETTE + "SELECT image_id, y, x, CAST(CASE WHEN idx % 3 = 0 THEN 0 ELSE floor(idx / 3) END AS BIGINT) AS idx FROM q3 JOIN pal USING (image_id, r, g, b)")
def palette_remap(spark, d):
    p = fx.coarse(fx.corpus(spark, d))
    colours = palette.distinct(p)
    mapping = colours.where("idx % 3 <> 0").select("image_id", F.col("idx").alias("old"), F.floor(F.col("idx") / 3).alias("idx"))
    return palette.remap(palette.indices(p, colours), mapping)


@query(S.CORPUS + S.PALETTE + "SELECT DISTINCT f3.image_id, f3.r, f3.g, f3.b, pal.idx FROM f3 LEFT JOIN pal ON f3.image_id = pal.image_id AND f3.r = pal.r AND f3.g = pal.g AND f3.b = pal.b")
def color_lookup(spark, d):
    p = fx.corpus(spark, d)
    return palette.lookup(palette.distinct(fx.coarse(p)), p.select("image_id", "r", "g", "b").distinct())


@query(S.MOSAIC + S.PALETTE_ONE + S.EPS)
def eps_clusters(spark, d):
    return palette.eps_clusters(palette.distinct(fx.coarse(fx.mosaic(spark, d))), 17.0).select("image_id", "idx", "cluster")


@query(S.CORPUS + S.BLACK_FIX)
def black_fix(spark, d):
    p = fx.blackened(fx.corpus(spark, d)).withColumn("segment", F.floor(F.col("x") / 10))
    return palette.black_fix(p).select(*PIXEL, "segment", "r", "g", "b")


@query(S.MOSAIC + S.HOLES)
def black_holes(spark, d):
    p = fx.mosaic(spark, d)
    coarse = p.select(*PIXEL, *(F.when(F.col("pid") % 7 < 2, 0).otherwise(F.floor(F.col(c) / 64) * 64).cast("long").alias(c) for c in "rgb"))
    return palette.fill_black_holes(coarse, 4)


@query(S.CORPUS + S.BLACK + "SELECT image_id, CAST(floor(x / 10) AS BIGINT) AS segment, CAST(count(*) AS BIGINT) AS pixels, CAST(count(*) FILTER (r + g + b = 0) AS BIGINT) AS black FROM blk3 GROUP BY image_id, floor(x / 10)")
def black_sources(spark, d):
    return segment.black_sources(fx.blackened(fx.corpus(spark, d)).withColumn("segment", F.floor(F.col("x") / 10)))


# overlay and codec


@query(S.MOSAIC + S.OVERLAY + "SELECT image_id, y, x, comp_ord, r, g, b FROM (SELECT *, row_number() OVER (PARTITION BY image_id, y, x ORDER BY comp_ord) AS k FROM placed) WHERE k = 1")
def overlay_first_wins(spark, d):
    return overlay.first_wins(fx.rectangles(fx.mosaic(spark, d)))


@query(S.MOSAIC + S.OVERLAY + "SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY o, yy, xx) AS BIGINT) AS idx, r, g, b FROM (SELECT image_id, r, g, b, -comp_ord AS o, y AS yy, x AS xx, row_number() OVER (PARTITION BY image_id, r, g, b ORDER BY -comp_ord, y, x) AS k FROM placed) WHERE k = 1 UNION ALL SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)")
def overlay_palette_order(spark, d):
    return overlay.palette_order(fx.rectangles(fx.mosaic(spark, d)))


@query(S.CORPUS + S.PALETTE + "SELECT image_id, max(idx) AS top, CASE WHEN max(idx) < 256 THEN 'uint8' WHEN max(idx) < 65536 THEN 'uint16' ELSE 'uint32' END AS dtype FROM q3 JOIN pal USING (image_id, r, g, b) GROUP BY image_id")
def dtype_narrow(spark, d):
    return codec.dtype(palette_indices(spark, d))


@query(S.CORPUS + S.PALETTE + "SELECT image_id, CAST(n AS BIGINT) AS n_colors, CAST(px AS BIGINT) AS pixels, CAST(px * 3 AS BIGINT) AS original_size, CAST(n * 3 + px * (CASE WHEN n <= 256 THEN 1 ELSE 2 END) + 50 AS BIGINT) AS compressed_size, round(CAST(px * 3 AS DOUBLE) / (n * 3 + px * (CASE WHEN n <= 256 THEN 1 ELSE 2 END) + 50), 6) AS ratio FROM (SELECT image_id, count(*) AS n FROM pal GROUP BY image_id) JOIN (SELECT image_id, count(*) AS px FROM q3 GROUP BY image_id) USING (image_id)")
def size_estimate(spark, d):
    p = fx.coarse(fx.corpus(spark, d))
    colours = palette.distinct(p)
    return rounded(codec.size_estimate(colours, palette.indices(p, colours)))


@query(S.CORPUS + S.RLE)
def rle_runs(spark, d):
    p = fx.coarse(fx.corpus(spark, d)).select(*PIXEL, (F.col("r") / 16).cast("long").alias("idx"))
    return codec.runs(p, longest=4)


@query(S.CORPUS + "SELECT image_id, y, x, CAST(floor(r / 16) AS BIGINT) AS idx FROM f3")
def rle_roundtrip(spark, d):
    p = fx.coarse(fx.corpus(spark, d)).select(*PIXEL, (F.col("r") / 16).cast("long").alias("idx"))
    return codec.expand(codec.runs(p, longest=4))


# neighbourhood kernels


@query(S.CORPUS + S.SOBEL + "SELECT image_id, y, x, CAST(gx AS BIGINT) AS gx, CAST(gy AS BIGINT) AS gy, round(sqrt(CAST(gx * gx + gy * gy AS DOUBLE)), 6) AS mag FROM sob")
def sobel_mag(spark, d):
    return rounded(edges.gradient(corpus_gray(spark, d)).drop("v"))


@query(S.MOSAIC + S.box(3) + "SELECT image_id, y, x, hits, round(CAST(hits AS DOUBLE) / 9, 6) AS density FROM box")
def box_density_3(spark, d):
    return rounded(grid.density(mosaic_white(spark, d), 3).drop("v"))


@query(S.MOSAIC + S.box(15) + "SELECT image_id, y, x, hits, round(CAST(hits AS DOUBLE) / 225, 6) AS density FROM box")
def box_density_15(spark, d):
    return rounded(grid.density(mosaic_white(spark, d), 15).drop("v"))


@query(S.MOSAIC + S.near(1) + "SELECT image_id, y, x, CAST(hi AS BIGINT) AS v FROM nb")
def dilate(spark, d):
    return grid.dilate(mosaic_white(spark, d), 3)


@query(S.MOSAIC + S.near(1) + "SELECT image_id, y, x, CAST(lo AS BIGINT) AS v FROM nb")
def erode(spark, d):
    return grid.erode(mosaic_white(spark, d), 3)


@query(S.MOSAIC + S.near(2) + S.near(2, "nb", "hi", "nb2") + "SELECT image_id, y, x, CAST(lo AS BIGINT) AS v FROM nb2")
def close(spark, d):
    return grid.close(mosaic_white(spark, d), 5)


@query(S.MOSAIC + S.near(1) + S.near(1, "nb", "lo", "nb2") + "SELECT image_id, y, x, CAST(hi AS BIGINT) AS v FROM nb2")
def thin_opening(spark, d):
    return grid.open_(mosaic_white(spark, d), 3)


@query(S.MOSAIC + S.ellipse(5) + "SELECT image_id, y, x, CAST(lo AS BIGINT) AS v FROM el2")
def closing_ellipse(spark, d):
    return grid.connect_by_closing(mosaic_white(spark, d), 5)


@query(S.MOSAIC + S.BRIDGE)
def gap_bridge(spark, d):
    return grid.bridge_gaps(mosaic_white(spark, d), 5, 0.2, 5, 9)


@query(S.MOSAIC + "SELECT image_id, y, x, CAST(CASE WHEN v = 0 AND ((coalesce(max(v) OVER (rx ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) > 0 AND coalesce(max(v) OVER (rx ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), 0) > 0) OR (coalesce(max(v) OVER (ry ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) > 0 AND coalesce(max(v) OVER (ry ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), 0) > 0)) THEN 255 ELSE v END AS BIGINT) AS v FROM f4 WINDOW rx AS (PARTITION BY image_id, y ORDER BY x), ry AS (PARTITION BY image_id, x ORDER BY y)")
def gap_strict(spark, d):
    return grid.fill_strict(mosaic_white(spark, d), 4, 15)


@query(S.MOSAIC + "SELECT a.image_id, a.y, a.x, CAST(CASE WHEN any_value(a.v) = 0 AND count(*) FILTER (b.v > 0) > 0.7 * (count(*) - 1) THEN 255 ELSE any_value(a.v) END AS BIGINT) AS v FROM f4 a JOIN f4 b ON b.y BETWEEN a.y - 2 AND a.y + 2 AND b.x BETWEEN a.x - 2 AND a.x + 2 GROUP BY a.image_id, a.y, a.x")
def gap_relaxed(spark, d):
    return grid.fill_relaxed(mosaic_white(spark, d), 5, 0.7)


@query(S.MOSAIC + S.GAP_DENSE)
def gap_dense(spark, d):
    return grid.fill_dense(mosaic_white(spark, d), 5, 5, 0.4, 100)


@query(S.MOSAIC_CC + S.components(True) + S.STATS + S.BIG + S.ellipse(3, "big") + "SELECT image_id, y, x, CAST(lo AS BIGINT) AS v FROM el2")
def dilation_connect(spark, d):
    return roi.connect_by_dilation(mosaic_white(spark, d), 3, 20)


@query(S.MOSAIC_CC + S.components(True) + S.STATS + S.BIG + S.ellipse(3, "big") + "SELECT f4.image_id, y, x, CAST(greatest(f4.v, el1.v) AS BIGINT) AS v FROM f4 JOIN el1 USING (y, x)")
def growing_connect(spark, d):
    return roi.connect_by_growing(mosaic_white(spark, d), 3, 20)


@query(S.MOSAIC_CC + S.components(True) + S.STATS + "SELECT image_id, label, top AS minr, \"left\" AS minc, least((SELECT max(y) + 1 FROM lab), top + height + CASE WHEN height = 1 OR width = 1 THEN 1 ELSE 0 END) AS maxr, least((SELECT max(x) + 1 FROM lab), \"left\" + width + CASE WHEN height = 1 OR width = 1 THEN 1 ELSE 0 END) AS maxc, area FROM st")
def region_boxes(spark, d):
    return roi.tight_boxes(mosaic_labels(spark, d))


@query(S.MOSAIC + S.BORDERS)
def meaningful_borders(spark, d):
    return grid.meaningful_borders(mosaic_white(spark, d), 0.5)


@query(S.MOSAIC + S.near(3) + S.near(3, "nb", "hi", "nb2") + "SELECT image_id, y, x, CAST(CASE WHEN f4.v = 0 AND lo > 0 AND (x % 7) > 0 THEN 255 ELSE f4.v END AS BIGINT) AS v FROM f4 JOIN nb2 USING (image_id, y, x)")
def protect_borders(spark, d):
    w = mosaic_white(spark, d)
    return grid.protect_borders(w, w.withColumn("v", F.when(F.col("x") % 7 == 0, 255).otherwise(0)), 7)


@query(S.CORPUS + S.BILATERAL)
def bilateral_blur(spark, d):
    return grid.bilateral(fx.corpus(spark, d))


# components and regions


@query(S.MOSAIC_CC + S.components(False) + "SELECT image_id, y, x, label FROM lab")
def cc4(spark, d):
    return mosaic_labels(spark, d, False)


@query(S.MOSAIC_CC + S.components(True) + "SELECT image_id, y, x, label FROM lab")
def cc8(spark, d):
    return mosaic_labels(spark, d, True)


@query(S.MOSAIC_CC + S.components(True) + S.STATS + "SELECT image_id, label, top, \"left\", height, width, area FROM st")
def region_stats(spark, d):
    return components.stats(mosaic_labels(spark, d))


@query(S.MOSAIC_CC + S.components(True) + S.STATS + "SELECT image_id, label, area FROM st ORDER BY area DESC, label LIMIT 5")
def region_topk(spark, d):
    return components.stats(mosaic_labels(spark, d)).select("image_id", "label", "area").orderBy(F.desc("area"), "label").limit(5)


@query(S.MOSAIC_CC + S.components(True) + S.box(5) + "SELECT image_id, y, x, CAST(CASE WHEN s.label IS NOT NULL THEN 0 ELSE f4.v END AS BIGINT) AS v FROM f4 LEFT JOIN lab USING (image_id, y, x) LEFT JOIN (SELECT label FROM lab JOIN box USING (image_id, y, x) GROUP BY label HAVING count(*) < 200 AND sum(hits) < count(*) * 18) s ON s.label = lab.label")
def remove_sparse(spark, d):
    w = mosaic_white(spark, d)
    return roi.remove_sparse(w, grid.density(w, 5), 200, 18.0)


@query(S.MOSAIC_CC.replace("v > 0", "v = 0") + S.components(False) + S.STATS + "SELECT f4.image_id, f4.y, f4.x, CAST(CASE WHEN st.area BETWEEN 10 AND 1000 THEN 255 ELSE f4.v END AS BIGINT) AS v FROM f4 LEFT JOIN lab ON lab.y = f4.y AND lab.x = f4.x LEFT JOIN st ON st.label = lab.label")
def fill_holes(spark, d):
    return roi.fill_holes(mosaic_white(spark, d), 10, 1000, False)


@query(S.MOSAIC + S.near(1) + S.near(1, "nb", "hi", "nb2") + ", fg AS (SELECT y * 100 + x AS pid, image_id, y, x FROM nb2 WHERE lo > 0)" + S.components(True) + S.STATS + "SELECT f4.image_id, f4.y, f4.x, CAST(CASE WHEN st.area >= 20 THEN 255 ELSE 0 END AS BIGINT) AS v FROM f4 LEFT JOIN lab ON lab.y = f4.y AND lab.x = f4.x LEFT JOIN st ON st.label = lab.label")
def remove_small(spark, d):
    return roi.remove_small(mosaic_white(spark, d), 20)


@query(S.MOSAIC_CC + S.components(True) + S.STATS + "SELECT image_id, CASE WHEN area < (SELECT ceil(count(*) * 3 / power(10, ceil(log10(count(*) * 3)) - 3)) FROM f4) THEN 'nonroi' ELSE 'roi' END AS kind, label, area FROM st")
def small_reassign(spark, d):
    masks = roi.split_disjoint(mosaic_white(spark, d))
    own = components.stats(components.label(masks.where("roi"))).join(masks.groupBy("image_id").agg((F.count("*") * 3).alias("size")), "image_id")
    return own.select("image_id", F.when(F.col("area") < roi.small_limit(F.col("size")), "nonroi").otherwise("roi").alias("kind"), "label", "area")


@query(S.MOSAIC_CC + S.components(True) + S.STATS + "SELECT st.image_id, st.label, lab.label AS parent_label FROM st JOIN lab ON lab.y = st.top + CAST(floor(st.height / 2) AS BIGINT) AND lab.x = st.left + CAST(floor(st.width / 2) AS BIGINT) WHERE lab.label <> st.label")
def region_parent(spark, d):
    return roi.hierarchy(mosaic_labels(spark, d))


@query(S.MOSAIC_CC + S.components(True) + S.STATS + S.THINNESS)
def thinness_score(spark, d):
    return rounded(roi.thinness(mosaic_labels(spark, d)).select("image_id", "label", "edges", "compactness", "aspect", "fill", "thinness"))


@query(S.MOSAIC_CC + S.components(True) + S.STATS + S.THIN_WEIGHTED)
def thin_score_weighted(spark, d):
    return rounded(roi.thin_score(roi.thinness(mosaic_labels(spark, d))).select("image_id", "label", "thin_score"))


@query(S.MOSAIC_CC + S.NOISE)
def remove_noise(spark, d):
    return roi.remove_noise(mosaic_white(spark, d), 75, 10.0, 5)


@query(S.MOSAIC_CC + S.components(True) + S.STATS + S.THIN_BOX)
def thin_score_box(spark, d):
    return rounded(roi.box_thinness(components.stats(mosaic_labels(spark, d))).select("image_id", "label", "thin_box"))


@query(S.MOSAIC_CC + S.components(True) + S.STATS + S.THIN_FAST)
def thin_score_fast(spark, d):
    return rounded(roi.fast_thinness(components.stats(mosaic_labels(spark, d))).select("image_id", "label", "thin_fast"))


@query()
def contour_arcs(spark, d):
    return rounded(roi.arc_perimeter(roi.contours(mosaic_labels(spark, d))))


@query()
def contour_thinness(spark, d):
    return rounded(roi.contour_thinness(mosaic_labels(spark, d)).select("image_id", "label", "arc", "thinness"))


@query()
def thin_heuristic(spark, d):
    return roi.thin_by_heuristic(mosaic_labels(spark, d), 0.8)


@query()
def remove_thin(spark, d):
    return roi.remove_thin(mosaic_white(spark, d), 0.6, 0.3, 5)


@query(S.MOSAIC + S.REGION_LIST)
def region_list(spark, d):
    return roi.regions(roi.split_masks(mosaic_white(spark, d), 3))


@query(S.MOSAIC + S.REGION_SWAP)
def region_swap(spark, d):
    return roi.swap_small(roi.split_disjoint(mosaic_white(spark, d)))


@query(S.MOSAIC + S.CONTEXT)
def contextual_clean(spark, d):
    return roi.contextual_clean(mosaic_white(spark, d))


@query()
def skeleton_connect(spark, d):
    return roi.connect_by_skeleton(corpus_white(spark, d), 2)


@query()
def centroid_connect(spark, d):
    return roi.connect_by_centroids(mosaic_white(spark, d), 5)


@query()
def distance_map(spark, d):
    return rounded(roi.distances(corpus_white(spark, d)), 4)


@query(S.MOSAIC + S.DENSE_EDGES)
def dense_edges(spark, d):
    return roi.dense_edges(mosaic_white(spark, d), 1.7)


@query()
def roi_detect(spark, d):
    limits = edges.scaled(edges.thresholds(mosaic_gray(spark, d)).where("method = 'otsu'")).drop("method")
    return roi.detect(edges.canny(mosaic_gray(spark, d), limits))


@query()
def get_regions(spark, d):
    return roi.image_masks(fx.corpus(spark, d))


# thresholds and edges


@query(S.CORPUS + S.SOBEL + "SELECT image_id, round(coalesce(quantile_cont(CASE WHEN gx <> 0 OR gy <> 0 THEN sqrt(CAST(gx * gx + gy * gy AS DOUBLE)) END, 0.7), 50), 6) AS low, round(coalesce(quantile_cont(CASE WHEN gx <> 0 OR gy <> 0 THEN sqrt(CAST(gx * gx + gy * gy AS DOUBLE)) END, 0.9), 150), 6) AS high FROM sob GROUP BY image_id")
def thr_percentile(spark, d):
    return rounded(edges.thresholds(corpus_gray(spark, d)).where("method = 'percentile'").drop("method"))


@query(S.CORPUS + S.SOBEL + "SELECT image_id, round(m - s * 0.5, 5) AS low, round(m + s * 0.5, 5) AS high FROM (SELECT image_id, avg(sqrt(CAST(gx * gx + gy * gy AS DOUBLE))) AS m, stddev_pop(sqrt(CAST(gx * gx + gy * gy AS DOUBLE))) AS s FROM sob GROUP BY image_id)")
def thr_gradient(spark, d):
    return rounded(edges.thresholds(corpus_gray(spark, d)).where("method = 'gradient'").drop("method"), 5)


@query(S.CORPUS + S.OTSU + "SELECT image_id, t FROM ot")
def thr_otsu(spark, d):
    return edges.otsu(corpus_gray(spark, d))


@query(S.CORPUS + S.SOBEL + S.OTSU + "SELECT image_id, round((t * 0.5 + m * 0.5) / 2, 5) AS low, round((t * 1.5 + m) / 2, 5) AS high FROM ot JOIN (SELECT image_id, avg(sqrt(CAST(gx * gx + gy * gy AS DOUBLE))) AS m FROM sob GROUP BY image_id) USING (image_id)")
def thr_hybrid(spark, d):
    return rounded(edges.thresholds(corpus_gray(spark, d)).where("method = 'hybrid'").drop("method"), 5)


@query(S.CORPUS + S.OTSU + "SELECT image_id, 'otsu' AS method, CAST(greatest(10, least(200, CAST(trunc(t * 0.5 * 1.3) AS BIGINT))) AS BIGINT) AS low, CAST(least(255, greatest(CAST(trunc(t * 1.5 * 1.3) AS BIGINT), greatest(10, least(200, CAST(trunc(t * 0.5 * 1.3) AS BIGINT))) + 10)) AS BIGINT) AS high FROM ot")
def thr_scaled(spark, d):
    return edges.scaled(edges.thresholds(corpus_gray(spark, d)).where("method = 'otsu'"), 1.3)


@query(S.MOSAIC + S.box(3) + "SELECT image_id, round(avg(hits / CAST(9 AS DOUBLE)), 6) AS mean, round(quantile_cont(hits / CAST(9 AS DOUBLE), 0.5), 6) AS median, round(quantile_cont(hits / CAST(9 AS DOUBLE), 0.7), 6) AS p70 FROM box JOIN f4 USING (image_id, y, x) WHERE v > 0 GROUP BY image_id")
def thr_suggest(spark, d):
    w = mosaic_white(spark, d)
    return rounded(edges.suggest(grid.density(w, 3), w))


@query(S.CORPUS + S.THR_FAST)
def thr_fast(spark, d):
    return rounded(edges.fast_thresholds(corpus_gray(spark, d)))


@query(S.MOSAIC_CC + S.components(True) + "SELECT lab.image_id, round(count(*) / CAST(count(DISTINCT label) AS DOUBLE) * stddev_pop(floor((r * 4899 + g * 9617 + b * 1868 + 8192) / 16384)), 4) AS score FROM lab JOIN f1 USING (image_id, y, x) GROUP BY lab.image_id")
def edge_quality(spark, d):
    return rounded(edges.quality(mosaic_white(spark, d), mosaic_gray(spark, d)), 4)


@query(S.MOSAIC + S.CANNY)
def canny(spark, d):
    g = mosaic_gray(spark, d)
    return edges.canny(g, g.select("image_id").distinct().select("image_id", F.lit(100).alias("low"), F.lit(200).alias("high")))


@query(S.MOSAIC + S.CANNY_RGB)
def canny_rgb(spark, d):
    p = fx.mosaic(spark, d)
    return edges.canny_rgb(p, p.select("image_id").distinct().select("image_id", F.lit(100).alias("low"), F.lit(200).alias("high")))


@query()
def canny_best(spark, d):
    return edges.best(mosaic_gray(spark, d))


# quality


@query(S.CORPUS + S.METRICS + "SELECT image_id, pixels, round(mse, 6) AS mse, round(mse_r, 6) AS mse_r, round(mse_g, 6) AS mse_g, round(mse_b, 6) AS mse_b, round(sqrt(mse), 6) AS rmse, round(mae, 6) AS mae, max_error, round(psnr, 6) AS psnr, rating, rating_five FROM met")
def corpus_report(spark, d):
    p = fx.coarse(fx.corpus(spark, d))
    colours = palette.distinct(p)
    decoded = palette.gather(palette.indices(p, colours), colours).selectExpr(*PIXEL, *(f"{c} + 8 as d{c}" for c in "rgb"))
    return rounded(quality.rated(quality.metrics(quality.pair(fx.corpus(spark, d), decoded))))


@query(S.CORPUS + S.METRICS + "SELECT image_id, pixels, round(mse, 6) AS mse, round(mse_r, 6) AS mse_r, round(mse_g, 6) AS mse_g, round(mse_b, 6) AS mse_b, round(sqrt(mse), 6) AS rmse, round(mae, 6) AS mae, max_error, round(psnr, 6) AS psnr FROM met")
def metrics_basic(spark, d):
    return rounded(quality.metrics(corpus_pairs(spark, d)))


@query(S.CORPUS + S.ADAPTIVE)
def metrics_adaptive(spark, d):
    return rounded(quality.adaptive(corpus_pairs(spark, d)), 5)


@query(S.CORPUS + S.SCOPES)
def metrics_percentile_scopes(spark, d):
    return rounded(quality.percentile_scopes(corpus_pairs(spark, d)))


@query(S.CORPUS + S.HISTOGRAM)
def error_histogram(spark, d):
    return quality.histogram(corpus_pairs(spark, d))


@query(S.MOSAIC + S.SSIM)
def ssim(spark, d):
    p = fx.mosaic(spark, d)
    return rounded(quality.ssim(quality.pair(p, fx.decoded(p)), 7))


@query(S.MOSAIC + S.SSIM.replace("SELECT CAST(0 AS BIGINT) AS image_id, round(avg", "SELECT CAST(0 AS BIGINT) AS image_id, CASE WHEN s > 0.95 THEN 'excellent' WHEN s > 0.85 THEN 'good' WHEN s > 0.7 THEN 'acceptable' ELSE 'poor' END AS rating FROM (SELECT (avg").replace("/ 3), 6) AS ssim FROM wi", "/ 3)) AS s FROM wi)"))
def rating_ssim(spark, d):
    p = fx.mosaic(spark, d)
    return quality.ssim(quality.pair(p, fx.decoded(p)), 7).select("image_id", color.rating_ssim(F.col("ssim")).alias("rating"))


@query()
def ssim_clean(spark, d):
    p = fx.mosaic(spark, d)
    return rounded(quality.ssim_clean(quality.pair(p, fx.decoded(p)), 7))


@query(S.CORPUS + S.DIFF)
def diff_weighted(spark, d):
    return rounded(quality.differences(corpus_pairs(spark, d)))


@query(S.CORPUS + S.METRICS + "SELECT image_id, rating, rating_five FROM met")
def rating(spark, d):
    return quality.rated(quality.metrics(corpus_pairs(spark, d))).select("image_id", "rating", "rating_five")


@query(S.CORPUS + S.METRICS + S.SUMMARY)
def corpus_summary(spark, d):
    return rounded(quality.summary(quality.metrics(corpus_pairs(spark, d))))


@query(S.CORPUS + S.METRICS + "SELECT rating_five AS bucket, CAST(count(*) AS BIGINT) AS images FROM met GROUP BY rating_five")
def corpus_buckets(spark, d):
    return quality.buckets(quality.metrics(corpus_pairs(spark, d)))


@query(S.CORPUS + S.METRICS + "SELECT 'best' AS side, CAST(k AS BIGINT) AS place, image_id, round(psnr, 6) AS psnr FROM (SELECT *, row_number() OVER (ORDER BY psnr DESC, image_id) AS k FROM met) WHERE k <= 3 UNION ALL SELECT 'worst', CAST(k AS BIGINT), image_id, round(psnr, 6) FROM (SELECT *, row_number() OVER (ORDER BY psnr, image_id) AS k FROM met) WHERE k <= 3")
def corpus_topk(spark, d):
    return rounded(quality.extremes(quality.metrics(corpus_pairs(spark, d)), 3))


@query(S.CORPUS + S.METRICS + "SELECT image_id, 'quantized' AS codec, round(pixels * 1.5 / 1024, 6) AS kilobytes, CAST(2 AS DOUBLE) AS ratio, CAST(12 AS DOUBLE) AS bpp, round(psnr, 6) AS psnr FROM met")
def codec_compare(spark, d):
    m = quality.metrics(corpus_pairs(spark, d)).withColumn("codec", F.lit("quantized"))
    sizes = m.select("image_id", "codec", (F.col("pixels") * 1.5).alias("bytes"))
    return rounded(quality.compare_codecs(sizes, m.select("image_id", "codec", "psnr"), fx.corpus(spark, d)))


@query(S.CORPUS + S.METRICS + "SELECT coalesce(CAST(image_id AS VARCHAR), 'AVERAGE') AS image, round(avg(psnr), 6) AS psnr, round(avg(mse), 6) AS mse, round(avg(mae), 6) AS mae FROM met GROUP BY ROLLUP (image_id)")
def average_row(spark, d):
    return rounded(quality.with_average(quality.metrics(corpus_pairs(spark, d))))


# segmentation


@query(S.CORPUS + "SELECT image_id, CAST(w AS BIGINT) AS \"window\", CAST(greatest(1, ceil(w / (1 + exp(-12 * (s - 0.5))))) AS BIGINT) AS segments FROM (SELECT image_id, ceil(ceil(log10(count(*) * 3)) * ln(count(*) * 3)) AS w, avg(r) / 255 AS s FROM f3 GROUP BY image_id)")
def split_sigmoid(spark, d):
    s = fx.corpus(spark, d).groupBy("image_id").agg(F.count("*").alias("size"), (F.avg("r") / 255).alias("overall"))
    return segment.segments_wanted(s).select("image_id", "window", "segments")


@query(S.CORPUS + S.LBP)
def lbp_hist(spark, d):
    return segment.lbp_histogram(corpus_gray(spark, d))


@query(S.CORPUS + "SELECT image_id, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM (SELECT image_id, CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER (PARTITION BY image_id) AS DOUBLE) AS t FROM (SELECT image_id, floor(floor((r * 4899 + g * 9617 + b * 1868 + 8192) / 16384) * 32 / 256) AS k, count(*) AS n FROM f3 GROUP BY ALL)) GROUP BY image_id")
def intensity_entropy(spark, d):
    return rounded(segment.entropy(corpus_gray(spark, d)))


@query()
def split_scores(spark, d):
    return rounded(segment.segments_wanted(segment.scores(fx.corpus(spark, d))), 5)


@query()
def slic_segments(spark, d):
    p = fx.corpus(spark, d)
    return segment.slic(p, p.groupBy("image_id").agg(F.lit(12).alias("segments")))


@query()
def segment_boundaries(spark, d):
    return segment.boundaries(slic_segments(spark, d)).select("image_id", "segment", "area", "num_points")


@query(S.CORPUS + S.BLOCK_BORDERS)
def block_boundaries(spark, d):
    blocks = fx.corpus(spark, d).select(*PIXEL, (F.floor(F.col("y") / 7) * 100 + F.floor(F.col("x") / 9)).alias("segment"))
    return segment.boundaries(blocks).select("image_id", "segment", "area", "num_points")


@query()
def watershed(spark, d):
    return segment.watershed(corpus_white(spark, d), 16)


# boundaries


@query(S.POLY + S.ARC + "SELECT shape_id, seq, round(step, 6) AS step, round(arc, 4) AS arc FROM arc")
def arc_length(spark, d):
    return boundary.arc_length(fx.polyline(spark, d)).select("shape_id", "seq", F.round("step", 6).alias("step"), F.round("arc", 4).alias("arc"))


@query(S.POLY + S.DIVIDE)
def divide_ring(spark, d):
    return boundary.divide(fx.polyline(spark, d), 10)


@query(S.POLY + S.CURVE)
def curvature_topk(spark, d):
    return boundary.key_points(fx.polyline(spark, d), 20).select("shape_id", "seq", "px", "py")


@query(S.POLY + "SELECT shape_id, seq, round(e, 6) AS error, round(sum(e) OVER (PARTITION BY shape_id ORDER BY seq), 4) AS total FROM (SELECT shape_id, seq, sqrt(power(px - floor(px), 2) + power(py - floor(py), 2)) AS e FROM pl)")
def cum_error(spark, d):
    p = fx.polyline(spark, d)
    return boundary.cumulative_error(p, p.withColumns({c: F.floor(c).cast("double") for c in ("px", "py")})).select("shape_id", "seq", F.round("error", 6).alias("error"), F.round("total", 4).alias("total"))


@query(S.POLY + "SELECT shape_id, round(avg(e), 6) AS mean, round(stddev_pop(e), 6) AS std, round(max(e), 6) AS high, round(quantile_cont(e, 0.95), 6) AS p95, CAST(count(*) FILTER (e > 0.001) AS BIGINT) AS over FROM (SELECT shape_id, sqrt(power(px - floor(px), 2) + power(py - floor(py), 2)) AS e FROM pl) GROUP BY shape_id")
def error_summary(spark, d):
    p = fx.polyline(spark, d)
    return rounded(boundary.error_summary(boundary.cumulative_error(p, p.withColumns({c: F.floor(c).cast("double") for c in ("px", "py")}))))


@query(S.POLY + S.DEDUPE)
def dedupe_seq(spark, d):
    p = fx.polyline(spark, d).withColumns({"px": F.floor(F.col("px") / 8).cast("double"), "py": F.lit(1.0)})
    return boundary.deduped(p)


@query(S.POLY + "SELECT shape_id, CAST(count(*) AS BIGINT) AS points, CAST(count(*) FILTER (seq % 4 = 0) AS BIGINT) AS kept, CAST(count(*) FILTER (seq % 4 = 0) * 8 AS BIGINT) AS bytes, round(count(*) * 16 / CAST(count(*) FILTER (seq % 4 = 0) * 8 AS DOUBLE), 6) AS ratio, round(count(*) FILTER (seq % 4 = 0) * 64 / CAST(count(*) AS DOUBLE), 6) AS bits_per_point FROM pl GROUP BY shape_id")
def boundary_storage(spark, d):
    p = fx.polyline(spark, d)
    return rounded(boundary.storage(p, p.where("seq % 4 = 0")))


@query(S.POLY + ", pt AS (SELECT shape_id, CAST(floor(seq / 100) AS BIGINT) AS part, seq, px, py FROM pl), rk AS (SELECT *, count(*) OVER (PARTITION BY shape_id, part) AS n, row_number() OVER (PARTITION BY shape_id, part ORDER BY seq) AS k FROM pt) SELECT shape_id, part, seq, px, py FROM rk WHERE part = 0 OR k > greatest(1, floor(n / 5))")
def combine_parts(spark, d):
    return boundary.combine(fx.polyline(spark, d).withColumn("part", F.floor(F.col("seq") / 100)).select("shape_id", "part", "seq", "px", "py"))


@query(S.POLY + ", ls AS (SELECT shape_id, count(*) - 1 AS last FROM pl GROUP BY shape_id), pt AS (SELECT shape_id, s, s * last / CAST(249 AS DOUBLE) AS a FROM ls, (SELECT unnest(range(0, 250)) AS s)) SELECT pt.shape_id, CAST(s AS BIGINT) AS seq, round(p.px + (coalesce(q.px, p.px) - p.px) * (a - floor(a)), 5) AS px, round(p.py + (coalesce(q.py, p.py) - p.py) * (a - floor(a)), 5) AS py FROM pt JOIN pl p ON p.shape_id = pt.shape_id AND p.seq = floor(a) LEFT JOIN pl q ON q.shape_id = pt.shape_id AND q.seq = floor(a) + 1")
def resample_linear(spark, d):
    return rounded(boundary.resampled(fx.polyline(spark, d), 250), 5)


@query()
def spline_fit(spark, d):
    return rounded(boundary.rebuild(boundary.compress(fx.polyline(spark, d)), 200), 4)


# kernels without a relational form


@query()
def kmeans_split(spark, d):
    p = palette.distinct(fx.coarse(fx.corpus(spark, d))).withColumn("cluster", F.col("idx") % 2)
    return palette.kmeans_split(p, 8)


@query()
def kmeans_whole(spark, d):
    return palette.hierarchical(palette.distinct(fx.coarse(fx.corpus(spark, d))), 20)


@query()
def clahe(spark, d):
    return enhance.shadows(corpus_gray(spark, d))


@query()
def clahe_regions(spark, d):
    return enhance.shadow_regions(corpus_gray(spark, d))


@query(S.CORPUS + S.LAB8)
def lab_bytes(spark, d):
    return fx.corpus(spark, d).select(*PIXEL, *(c.alias(n) for c, n in zip(color.lab8(), ("l", "a", "bb"), strict=True)))


@query()
def clahe_images(spark, d):
    return enhance.images(fx.corpus(spark, d))


@query()
def clahe_gain(spark, d):
    g = corpus_gray(spark, d)
    return rounded(enhance.brightness_gain(g, enhance.shadows(g, least=20)))


@query()
def zlib_container(spark, d):
    p = fx.coarse(fx.corpus(spark, d))
    colours = palette.distinct(p)
    return codec.containers(palette.indices(p, colours), colours).select("image_id", "height", "width", "n_colors", "dtype", "bytes")


@query(S.CORPUS + S.PALETTE + "SELECT image_id, y, x, r, g, b FROM q3")
def container_roundtrip(spark, d):
    p = fx.coarse(fx.corpus(spark, d))
    colours = palette.distinct(p)
    return codec.pixels(codec.containers(palette.indices(p, colours), colours, "rle"))


@query()
def hierarchical_pipeline(spark, d):
    return rounded(encode_images(fx.corpus(spark, d)))
