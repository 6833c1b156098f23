"""The three-level codec: sub-regions, regions, image; then decoding and assessment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color
from ..functions.durable import durable
from ..operators import codec, edges, overlay, palette, quality, roi, segment

PIXEL = ["image_id", "y", "x"]
#: Quality of the levels: ROI and non-ROI sub-regions, their regions (twice that), the image (the sum).
ROI_QUALITY, OTHER_QUALITY = 20, 10


def _level(pixels: DataFrame, part: list[str], value: int) -> DataFrame:
    """pixels after one quantization level, every group of `part` on its own."""
    key = F.struct(*part) if len(part) > 1 else F.col(part[0])
    own = pixels.withColumn("home", F.col("image_id")).withColumn("image_id", F.xxhash64(key)).transform(durable)
    colours, index = palette.quantize(own, value)
    back = palette.gather(index, colours)
    rest = [c for c in own.columns if c not in "rgb"]
    return own.select(*rest).join(back, PIXEL).drop("image_id").withColumnRenamed("home", "image_id")


def region_segments(pixels: DataFrame, regions: DataFrame) -> DataFrame:
    """(image_id, region, y, x, r, g, b, segment): every region scored in its bounding box and segmented on its own.

    regions: (image_id, region, y, x); the segments wanted follow from the score and the box, without a cap.
    """
    boxes = regions.groupBy("image_id", "region").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    canvas = pixels.join(F.broadcast(boxes), "image_id").where("y between y0 and y1 and x between x0 and x1").select("image_id", "region", "y", "x", "r", "g", "b")
    own = regions.select("image_id", "region", "y", "x", F.lit(True).alias("own"))
    canvas = canvas.join(own, ["image_id", "region", "y", "x"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    canvas = canvas.drop("image_id").withColumnRenamed("region", "image_id").transform(durable)
    box = boxes.select(F.col("region").alias("image_id"), ((F.col("y1") - F.col("y0") + 1) * (F.col("x1") - F.col("x0") + 1)).alias("size"))
    wanted = segment.segments_wanted(segment.scores(canvas, "own").drop("size").join(box, "image_id"))
    found = segment.slic(canvas.where("own"), wanted).withColumnRenamed("image_id", "region")
    return found.join(F.broadcast(boxes.select("image_id", "region")), "region")


def encode_images(pixels: DataFrame, roi_mask: DataFrame | None = None) -> DataFrame:
    """(image_id, original_size, bytes, ratio, psnr): images through all levels, packed, decoded and compared.

    roi_mask: (image_id, y, x, v); by default the masks of `roi.detect` on each image's best edge map.
    """
    pixels = pixels.select(*PIXEL, "r", "g", "b").transform(durable)
    if roi_mask is None:
        masks = roi.detect(edges.best(pixels.select(*PIXEL, color.gray().alias("v")).transform(durable)))
    else:
        masks = roi.split_masks(roi_mask, 1)
    regions = roi.swap_small(masks.transform(durable)).select("image_id", "kind", F.xxhash64("image_id", "kind", "label").alias("region"), "y", "x").transform(durable)
    segments = region_segments(pixels, regions.drop("kind")).transform(durable)
    done = None
    for place, (kind, value) in enumerate((("roi", ROI_QUALITY), ("nonroi", OTHER_QUALITY))):
        own = segments.join(regions.where(F.col("kind") == kind).select("region", "y", "x"), ["region", "y", "x"], "left_semi")
        own = own.withColumn("segment", F.xxhash64("region", "segment"))
        own = palette.black_fix(own)
        sub = _level(own, ["image_id", "segment"], value)
        region = _level(sub.select(*PIXEL, "r", "g", "b"), ["image_id"], min(100, value * 2))
        region = region.select(*PIXEL, "r", "g", "b", F.lit(place).cast("long").alias("comp_ord"))
        done = region if done is None else done.unionByName(region)
    merged = overlay.first_wins(done).select(*PIXEL, "r", "g", "b").transform(durable)
    colours, index = palette.quantize(merged, min(100, 2 * (ROI_QUALITY + OTHER_QUALITY)))
    packed = codec.containers(index, colours).transform(durable)
    decoded = codec.pixels(packed).selectExpr(*PIXEL, *(f"{c} as d{c}" for c in "rgb"))
    m = quality.metrics(quality.pair(pixels, decoded))
    sizes = packed.select("image_id", "bytes")
    return m.join(sizes, "image_id").select("image_id", (F.col("pixels") * 3).alias("original_size"), "bytes", (F.col("pixels") * 3 / F.col("bytes")).alias("ratio"), "psnr")
