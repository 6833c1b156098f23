"""Readers, writers and the streaming score."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelflow.operators import codec, palette, quality
from pixelflow.plans.codec_plan import encode_images, region_segments
from pixelflow.sources import fixtures as fx
from pixelflow.sources import images
from pixelflow.streaming.scoring import running_metrics

DIR = "/root/testdata/sf0.001"


def ppm(path, rgb):
    import struct
    import zlib

    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + row.tobytes() for row in rgb.astype(np.uint8))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_png_is_read_exactly(spark, tmp_path):
    rgb = np.random.default_rng(1).integers(0, 256, (4, 5, 3))
    ppm(tmp_path / "a.png", rgb)
    got = np.zeros((4, 5, 3), int)
    for r in images.read_images(spark, str(tmp_path)).collect():
        got[r.y, r.x] = r.r, r.g, r.b
    assert np.array_equal(got, rgb)
    assert images.file_sizes(spark, str(tmp_path)).count() == 1


def test_container_files(spark, tmp_path):
    p = fx.coarse(fx.corpus(spark, DIR))
    colours = palette.distinct(p)
    index = palette.indices(p, colours)
    images.write_containers(index, colours, str(tmp_path / "table"))
    assert images.read_containers(spark, str(tmp_path / "table")).exceptAll(p.select("image_id", "y", "x", "r", "g", "b")).count() == 0
    (tmp_path / "files").mkdir()
    one = codec.containers(index, colours).first()
    (tmp_path / "files/a.bin").write_bytes(bytes(one.data))
    (tmp_path / "files/b.bin").write_bytes(b"nothing")
    good, bad = images.read_container_files(spark, str(tmp_path / "files"))
    assert good.count() == one.height * one.width and bad.count() == 1


def test_points_and_arrays(spark, tmp_path):
    p = spark.createDataFrame([(0, 0, 1.23456, 1000.5), (0, 1, 2.0, 3.0)], "shape_id long, seq long, px double, py double")
    images.write_points(p, str(tmp_path / "csv"))
    assert {(r.seq, r.px, r.py) for r in images.read_points(spark, str(tmp_path / "csv")).collect()} == {(0, 1.235, 1000.5), (1, 2.0, 3.0)}
    (tmp_path / "n").mkdir()
    np.save(tmp_path / "n/a.npy", np.arange(6).reshape(3, 2))
    assert images.read_npy(spark, str(tmp_path / "n")).agg(F.sum("value")).first()[0] == 15


def test_resize(spark):
    p = spark.createDataFrame([(0, y, x, y * 4 + x) for y in range(4) for x in range(4)], "image_id long, y long, x long, v long")
    assert {(r.y, r.x): r.v for r in images.resized(p, 2, 2).collect()} == {(0, 0): 0, (0, 1): 2, (1, 0): 8, (1, 1): 10}


def test_metrics_sink(spark, tmp_path):
    images.write_metrics(spark.createDataFrame([(1, 2.0)], "image_id long, psnr double"), str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).first()["psnr"] == "2.0"


def test_stream_equals_batch(spark, tmp_path):
    p = fx.corpus(spark, DIR).selectExpr("image_id", "y", "x", "r", "g", "b", *(f"cast(floor({c} / 16) as bigint) * 16 + 8 as d{c}" for c in "rgb"))
    p.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = running_metrics(stream).writeStream.outputMode("complete").format("memory").queryName("scores").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.image_id: (r.pixels, r.max_error, r.psnr) for r in spark.table("scores").collect()}
    want = {r.image_id: (r.pixels, r.max_error, r.psnr) for r in quality.metrics(p).collect()}
    assert got.keys() == want.keys() and all(got[k][:2] == want[k][:2] and got[k][2] == pytest.approx(want[k][2]) for k in got)


def test_three_levels(spark):
    out = encode_images(fx.corpus(spark, DIR).where("image_id < 3")).collect()
    assert out and all(r.psnr > 20 and r.bytes > 0 for r in out)


def test_regions_are_segmented_on_their_own_without_a_cap(spark):
    rng = np.random.default_rng(3)
    noise = rng.integers(1, 256, (100, 100, 3)).tolist()
    pixels = spark.createDataFrame([(0, y, x, *(noise[y][x] if x < 100 else (90, 90, 90))) for y in range(100) for x in range(140)], "image_id long, y long, x long, r long, g long, b long")
    regions = pixels.selectExpr("image_id", "cast(x >= 100 as bigint) as region", "y", "x")
    out = region_segments(pixels, regions)
    assert out.count() == 14000
    n = {r.region: r.n for r in out.groupBy("region").agg(F.countDistinct("segment").alias("n")).collect()}
    assert n[0] > 16 and n[1] < 4


def test_canvas_is_filled(spark):
    from pixelflow.operators import overlay

    merged = spark.createDataFrame([(0, 1, 1, 5, 6, 7)], "image_id long, y long, x long, r long, g long, b long")
    out = overlay.canvas(merged, 2, 3)
    assert out.count() == 6 and out.agg(F.sum("r")).first()[0] == 5


def test_npy_tables(spark, tmp_path):
    rows = [("a", 0, 1, 2.5), ("a", 2, 0, -1.0), ("b", 0, 0, 4.0)]
    images.write_npy(spark.createDataFrame(rows, "name string, row long, column long, value double"), str(tmp_path / "m"))
    got = {tuple(r) for r in images.read_npy_table(spark, str(tmp_path / "m")).collect()}
    assert set(rows) <= got and len(got) == 7
