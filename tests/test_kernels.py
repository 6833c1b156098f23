"""Hand-sized arrays: borders, ties, ordering, and properties of kernels without a relational form."""

import sys

import numpy as np
import pytest
from conftest import as_rows, hand
from pyspark.sql import functions as F

from pixelflow.functions import color
from pixelflow.functions.durable import durable
from pixelflow.operators import boundary, codec, components, edges, enhance, grid, palette, quality, roi, segment

RNG = np.random.default_rng(7)


def flood(mask, eight):
    label, count = np.zeros(mask.shape, int), 0
    for y, x in np.argwhere(mask):
        if label[y, x]:
            continue
        count += 1
        todo = [(y, x)]
        while todo:
            a, b = todo.pop()
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not label[a, b]:
                label[a, b] = count
                todo += [(a + dy, b + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (eight or not (dy and dx))]
    return label


@pytest.mark.parametrize("eight", [False, True])
@pytest.mark.parametrize("stripe", [3, 512])
def test_components_with_seams(spark, eight, stripe):
    mask = RNG.random((13, 17)) < 0.5
    df = hand(spark, (mask * 255).tolist())
    got = np.zeros(mask.shape, int)
    for r in components.label(df.where("v > 0"), eight, stripe).collect():
        got[r.y, r.x] = r.label
    assert np.array_equal(got, flood(mask, eight))


def test_components_of_nothing(spark):
    assert components.label(hand(spark, [[0, 0]]).where("v > 0")).count() == 0


def test_closure_of_a_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (200, 200)], "a long, b long")
    got = {r.node: r.root for r in components.closure(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200}


def test_box_reflects(spark):
    v = RNG.integers(0, 2, (7, 9)) * 255
    padded = np.pad(v > 0, 2, mode="reflect").astype(int)
    want = [[int(padded[y : y + 5, x : x + 5].sum()) for x in range(9)] for y in range(7)]
    assert as_rows(grid.density(hand(spark, v.tolist()), 5), "hits") == want


def test_ellipse_closing(spark):
    v = (RNG.random((12, 12)) < 0.2) * 255
    halves = grid.ellipse(3)
    assert halves == [0, 2, 3, 3, 3, 2, 0]

    def pass_(a, fn, empty):
        out = np.empty_like(a)
        for y in range(12):
            for x in range(12):
                near = [a[y + dy - 3, x + dx] for dy, h in enumerate(halves) for dx in range(-h, h + 1) if 0 <= y + dy - 3 < 12 and 0 <= x + dx < 12]
                out[y, x] = fn(near)
        return out

    assert as_rows(grid.connect_by_closing(hand(spark, v.tolist()), 3)) == pass_(pass_(v, max, 0), min, 255).tolist()


def test_gap_is_bridged(spark):
    v = [[0] * 9 for _ in range(9)]
    v[4] = [255, 255, 255, 0, 0, 255, 255, 255, 255]
    out = as_rows(grid.bridge_gaps(hand(spark, v), 4, 0.1, 4, 5))
    assert out[4] == [255] * 9 and out[0] == [0] * 9


def test_canny_of_a_step(spark):
    v = [[0] * 5 + [200] * 5 for _ in range(8)]
    df = hand(spark, v)
    limits = spark.createDataFrame([(0, 100, 300)], "image_id long, low long, high long")
    out = np.array(as_rows(edges.canny(df, limits)))
    assert (out.max(axis=1) == 255).all() and (out > 0).sum() == 8


def test_flat_image_has_no_edges(spark):
    df = hand(spark, [[9] * 6] * 6)
    assert max(map(max, as_rows(edges.best(df)))) == 0
    rows = {r.method: (r.low, r.high) for r in edges.thresholds(df).collect()}
    assert rows["percentile"] == (50.0, 150.0)


def test_black_stays_black_and_parts_are_small(spark):
    colours = [(0, i, *map(int, c)) for i, c in enumerate(np.unique(RNG.integers(0, 256, (200, 3)), axis=0))] + [(0, 999, 0, 0, 0)]
    df = spark.createDataFrame(colours, "image_id long, idx long, r long, g long, b long")
    clustered = palette.eps_clusters(df, 60.0)
    assert clustered.where("idx = 999").first()["cluster"] == -1
    split = palette.kmeans_split(clustered, 7)
    assert split.groupBy("cluster", "part").count().agg(F.max("count")).first()[0] <= 7
    fresh, mapping = palette.reduced(split)
    assert mapping.count() == len(colours) and fresh.where("r + g + b = 0").count() == 1


def test_quality_zero_is_refused(spark):
    with pytest.raises(ValueError):
        palette.params(spark.range(1).selectExpr("id as image_id", "id as n"), 0)


@pytest.mark.parametrize("method", ["deflate", "rle"])
@pytest.mark.parametrize("top", [1, 255, 256, 70000])
def test_container_round_trip(method, top):
    index = np.repeat(RNG.integers(0, top, 60), RNG.integers(1, 3000, 60))
    colours = RNG.integers(0, 256, (top, 3))
    h, w, p, back, kind = codec.unpack(codec.pack(1, len(index), colours, index, "uint8" if top <= 256 else "uint16" if top <= 65536 else "uint32", method))
    assert np.array_equal(back, index) and np.array_equal(p, colours) and (h, w) == (1, len(index))


def test_container_refuses_other_bytes():
    with pytest.raises(ValueError):
        codec.unpack(b"other bytes")


def test_identical_images(spark):
    rows = [(0, y, x, 5, 6, 7, 5, 6, 7) for y in range(9) for x in range(9)]
    df = spark.createDataFrame(rows, "image_id long, y long, x long, r long, g long, b long, dr long, dg long, db long")
    m = quality.rated(quality.metrics(df)).first()
    assert m.psnr == float("inf") and m.rating == "excellent" and quality.ssim(df).first().ssim == pytest.approx(1)
    assert quality.differences(df).agg(F.max("absolute")).first()[0] == 0
    assert quality.adaptive(df).first().n_zscore == 0


def test_otsu_splits_two_levels(spark):
    assert edges.otsu(hand(spark, [[10] * 4 + [200] * 4] * 4)).first().t == 10


def test_chamfer_and_skeleton():
    mask = np.zeros((9, 15), bool)
    mask[2:7, 2:13] = True
    d = roi.chamfer(mask)
    assert d[4, 7] == pytest.approx(3 * 0.955) and d[0, 0] == 0
    thin = roi.skeleton(mask)
    assert thin.any() and (thin & ~mask).sum() == 0 and thin.sum() < mask.sum() / 3


def test_areas_add_up(spark):
    v = ((RNG.random((20, 20)) < 0.4) * 255).tolist()
    masks = roi.split_disjoint(hand(spark, v))
    assert roi.regions(masks).agg(F.sum("area")).first()[0] == 400
    assert roi.swap_small(masks).count() == 400


def test_slic_covers_every_pixel(spark):
    rows = [(0, y, x, *map(int, RNG.integers(0, 256, 3))) for y in range(20) for x in range(20)]
    df = spark.createDataFrame(rows, "image_id long, y long, x long, r long, g long, b long")
    out = segment.slic(df, df.groupBy("image_id").agg(F.lit(9).alias("segments")))
    assert out.count() == 400 and 1 < out.select("segment").distinct().count() <= 16
    s = segment.scores(df).first()
    assert 0 <= s.overall <= 1 and s.color_score > 0


def test_small_regions_score_nothing(spark):
    df = spark.createDataFrame([(0, 0, x, x, x, x) for x in range(9)], "image_id long, y long, x long, r long, g long, b long")
    assert segment.scores(df).first().overall == 0


def test_spline_passes_its_points():
    t = np.array([0.0, 1, 2.5, 4, 5])
    v = np.column_stack([np.sin(t), np.cos(t)])
    v[-1] = v[0]
    for periodic in (False, True):
        assert np.allclose(boundary.natural_spline(t, v, t, periodic), v)


def test_compressed_boundary_comes_back(spark):
    a = np.linspace(0, 2 * np.pi, 200, endpoint=False)
    df = spark.createDataFrame([(0, i, float(50 * np.cos(t)), float(30 * np.sin(t))) for i, t in enumerate(a)], "shape_id long, seq long, px double, py double")
    keys = boundary.compress(df, 5, 0.3)
    assert keys.count() < 120
    out = np.array([(r.px, r.py) for r in boundary.rebuild(keys, 400).collect()])
    far = np.abs((out[:, 0] / 50) ** 2 + (out[:, 1] / 30) ** 2 - 1).max()
    assert far < 0.1


def test_clahe_keeps_bright_pixels(spark):
    v = RNG.integers(0, 256, (16, 16))
    out = np.array(as_rows(enhance.shadows(hand(spark, v.tolist()), 100)))
    assert np.array_equal(out[v >= 100], v[v >= 100]) and (out != v).any()
    assert len(enhance.clahe_column(np.zeros(0, int))) == 0


def test_lab_of_known_colours(spark):
    l_, a_, b_ = color.lab()
    rows = spark.createDataFrame([(255, 255, 255), (0, 0, 0), (255, 0, 0)], "r long, g long, b long").select(l_, a_, b_).collect()
    assert np.allclose(np.array(rows, float), [[100, 0, 0], [0, 0, 0], [53.24, 80.09, 67.2]], atol=0.1)


def shape(spark, text):
    """A component as (image_id, y, x, label) of the marks of a drawing."""
    return spark.createDataFrame([(0, y, x, 1) for y, row in enumerate(text.split()) for x, c in enumerate(row) if c == "#"], "image_id long, y long, x long, label long")


@pytest.mark.parametrize(
    ("text", "points", "arc"),
    [("#", 1, 0.0), ("##", 2, 2.0), ("###", 4, 4.0), ("## ##", 4, 4.0), ("### ### ###", 8, 8.0), ("#. .#", 2, 2 * 2**0.5), ("### #.# ###", 8, 8.0), (".#. ### .#.", 4, 4 * 2**0.5), ("#.. #.. ###", 7, 6 + 2**0.5)],
)
def test_contours_of_drawings(spark, text, points, arc):
    got = roi.arc_perimeter(roi.contours(shape(spark, text))).first()
    assert (got.points, got.arc) == (points, pytest.approx(arc))


def test_contours_follow_the_outer_border(spark):
    mask = np.random.default_rng(3).random((24, 24)) < 0.6
    df = hand(spark, np.where(mask, 255, 0).tolist())
    labels = components.label(df.where("v > 0"))
    at = {(r.y, r.x): r.label for r in labels.collect()}
    lines = {}
    for r in roi.contours(labels).orderBy("label", "seq").collect():
        lines.setdefault(r.label, []).append((r.y, r.x))
    assert set(lines) == set(at.values())
    for number, line in lines.items():
        own = {p for p, k in at.items() if k == number}
        assert set(line) <= own
        for (a, b), (c, d) in zip(line, line[1:] + line[:1], strict=True):
            assert max(abs(a - c), abs(b - d)) <= 1
        # what can be reached from outside in 4 steps touches the line, in the whole plane round the component
        outside, todo = set(), [(-1, -1)]
        while todo:
            y, x = todo.pop()
            if (y, x) in outside or (y, x) in own or not (-1 <= y <= 24 and -1 <= x <= 24):
                continue
            outside.add((y, x))
            todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
        rim = {(y, x) for y, x in own if {(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)} & outside}
        assert rim <= set(line)
    s = roi.contour_thinness(labels)
    assert s.where("thinness < 0").count() == 0 and s.count() == len(lines)
    assert roi.thin_by_heuristic(labels, 0.4).join(s.where("thinness < 0.4"), ["image_id", "label"], "left_anti").count() == 0
    assert roi.thin_by_boxes(labels, 0.5, 1, 10_000).count() <= s.count()


def test_colours_survive_lab_bytes(spark):
    rows = [(0, 0, k, *map(int, RNG.integers(0, 256, 3))) for k in range(300)] + [(0, 0, 300, 0, 0, 0), (0, 0, 301, 255, 255, 255)]
    df = spark.createDataFrame(rows, "image_id long, y long, x long, r long, g long, b long")
    lab = df.select("x", "r", "g", "b", *(c.alias(n) for c, n in zip(color.lab8(), ("l", "a", "bb"), strict=True)))
    back = lab.select("x", "r", "g", "b", "l", *(c.alias(f"n{n}") for c, n in zip(color.from_lab8("l", "a", "bb"), "rgb", strict=True)))
    got = {r.x: r for r in back.collect()}
    assert (got[300].l, got[301].l) == (0, 255) and (got[301].nr, got[301].ng, got[301].nb) == (255, 255, 255)
    assert np.mean([abs(r.r - r.nr) + abs(r.g - r.ng) + abs(r.b - r.nb) for r in got.values()]) < 6
    for by_region in (False, True):
        out = {r.x: r for r in enhance.images(df, by_region=by_region).collect()}
        assert len(out) == len(got)
        assert all((out[x].r, out[x].g, out[x].b) == (r.r, r.g, r.b) for x, r in got.items() if r.l >= 100)


def test_black_holes(spark):
    a, b, o = (9, 0, 0), (0, 9, 0), (0, 0, 0)
    rows = [[a, a, b, b], [a, o, o, b], [b, o, b, b], [o, a, a, o]]
    df = spark.createDataFrame([(0, y, x, *c) for y, row in enumerate(rows) for x, c in enumerate(row)], "image_id long, y long, x long, r long, g long, b long")
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in palette.fill_black_holes(df, 3).collect()}
    assert [got[p] for p in ((1, 1), (1, 2), (2, 1))] == [b] * 3  # b stands next to the hole four times, a three times
    assert got[3, 0] == b and got[3, 3] == b  # a tie goes to the first in raster order
    assert {(r.y, r.x): (r.r, r.g, r.b) for r in palette.fill_black_holes(df, 2).collect()}[1, 1] == o
    one = spark.createDataFrame([(0, 0, 0, 0, 0, 0)], "image_id long, y long, x long, r long, g long, b long")
    assert palette.fill_black_holes(one).first().r == 0


def test_long_splines_and_many_colours():
    t = np.linspace(0, 7, 6000)
    v = np.column_stack([np.sin(t), np.cos(t)])
    at = np.linspace(0, 7, 500)
    assert np.allclose(boundary.natural_spline(t, v, at), np.column_stack([np.sin(at), np.cos(at)]), atol=1e-4)
    points = RNG.integers(0, 256, (5000, 3))
    label = palette.lloyd(points, 500, 3)
    assert len(label) == 5000 and len(np.unique(label)) > 400


def test_best_thresholds_of_hashed_images(spark):
    rows = [(2**62 + k, y, x, 30 if x < 8 else 180 + (y + k) % 3) for k in range(2) for y in range(12) for x in range(16)]
    df = spark.createDataFrame(rows + [(-5, 0, 0, 7)], "image_id long, y long, x long, v long")
    out = edges.best(df)
    assert out.count() == len(rows) + 1 and out.where("v > 0").select("image_id").distinct().count() == 2
    limits = {r.image_id: (r.low, r.high) for r in edges.best_limits(df).collect()}
    assert limits[-5] == (50, 150) and len(limits) == 3


def test_size_estimates_stay_bounded_along_checkpoints(spark):
    """Each join multiplies the sides' estimates; a checkpoint must not hand the product on."""
    now = want = spark.range(20).selectExpr("id", "id % 3 as v")
    for _ in range(6):
        now = durable(now.join(now.select("id", F.col("v").alias("w")), "id").selectExpr("id", "(v + w) % 7 as v"))
        assert now._jdf.queryExecution().analyzed().stats().sizeInBytes().bit_length() <= 63
    for _ in range(6):
        want = want.selectExpr("id", "(v + v) % 7 as v")
    assert now.columns == ["id", "v"] and now.dtypes == want.dtypes and sorted(now.collect()) == sorted(want.collect())


def test_checkpoint_of_an_estimate_with_more_digits_than_python_reads(spark):
    """Between two checkpoints the estimates of all joined tables multiply, here of 64."""
    one = now = durable(spark.range(1).coalesce(1))
    while one._jdf.queryExecution().analyzed().stats().sizeInBytes().bit_length() < 60:
        one = now = durable(one.crossJoin(one.select(F.col("id").alias("b"))).select("id"))
    for _ in range(6):
        now = now.crossJoin(now.select(F.col("id").alias("b"))).selectExpr("id + b as id")
    limit = sys.get_int_max_str_digits()
    sys.set_int_max_str_digits(640)
    try:
        out = durable(now)
    finally:
        sys.set_int_max_str_digits(limit)
    assert out._jdf.queryExecution().analyzed().stats().sizeInBytes().bit_length() <= 63 and [r.id for r in out.collect()] == [0]
