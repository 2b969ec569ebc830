"""Raster operators against NumPy, on small arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import pixel
from rasterloom.operators import axis, blend, choose, focus, geometry, tiles
from rasterloom.sources import listing

KEYS = ["stack"]


def frame(spark, a):
    rows = [(0, int(y), int(x), float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "stack int, y int, x int, v double")


def array(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.y, r.x] = r[name]
    return out


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(3).integers(0, 65536, (9, 7)).astype(float)


def test_smooth_is_a_mirrored_convolution(spark, image):
    k = axis.gaussian(3)
    got = array(focus.smooth(frame(spark, image), KEYS, F.col("v"), "s", 9, 7, 3), "s", image.shape)
    p = np.pad(image, 3, mode="reflect")
    w = np.array([k[d] for d in range(-3, 4)])
    want = sum(w[i] * w[j] * p[i : i + 9, j : j + 7] for i in range(7) for j in range(7))
    assert np.allclose(got, want)


def test_sobel_and_laplacian(spark, image):
    df, p = frame(spark, image), np.pad(image, 1, mode="reflect")
    s = focus.sobel(df, KEYS, F.col("v"), 9, 7)
    gx = sum(w * (p[i : i + 9, 2:9] - p[i : i + 9, 0:7]) for i, w in enumerate((1, 2, 1)))
    assert np.array_equal(array(s, "gx", image.shape), gx)
    lap = axis.several(df, KEYS, F.col("v"), 9, 7, focus.LAPLACE)
    want = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * image
    assert np.array_equal(array(lap, "lap", image.shape), want)


def test_pyramid_gives_the_image_back(spark, image):
    levels = blend.pyramid(frame(spark, image), KEYS, "v", 9, 7, 2)
    assert np.allclose(array(blend.collapsed(levels, KEYS, "v", 9, 7, 2), "v", image.shape), image)


def test_resize_keeps_the_mean(spark, image):
    df = axis.along(frame(spark, image), axis.resized(spark, 7, 3), "x", [*KEYS, "y"], {"v": F.col("v")}, 7)
    df = axis.along(df, axis.resized(spark, 9, 4), "y", [*KEYS, "x"], {"v": F.col("v")}, 9)
    got = array(df, "v", (4, 3))
    assert np.isclose((got * 9 * 7 / 12).sum(), image.sum())


def test_cascade_drops_a_displaced_tie(spark):
    rows = spark.createDataFrame([(0, 0, 0, f, s) for f, s in enumerate([7.0, 7.0, 7.0, 9.0])], "stack int, y int, x int, frame long, score double")
    assert [c.frame for c in choose.cascade(rows, KEYS).first().c] == [3, 1, 2]
    assert [r.frame for r in choose.ranked(rows, KEYS).orderBy("rank").collect()] == [3, 0, 1]
    assert choose.winner(rows.limit(3), KEYS).first().frame == 0


def test_no_score_is_no_candidate(spark):
    rows = spark.createDataFrame([(0, 0, 0, 1, -1.0)], "stack int, y int, x int, frame long, score double")
    assert choose.ranked(rows, KEYS).count() == 0 and choose.winner(rows, KEYS).count() == 0


def test_erode_and_median(spark):
    a = np.ones((6, 6))
    a[2, 3] = 0
    got = array(choose.eroded(frame(spark, a), KEYS, "v", 6, 6, 1), "v", a.shape)
    assert got.sum() == 36 - 9
    labels = frame(spark, np.arange(36).reshape(6, 6) % 5).withColumn("label", F.col("v").cast("int"))
    p = np.pad(np.arange(36).reshape(6, 6) % 5, 1, mode="edge")
    want = np.array([[np.median(p[i : i + 3, j : j + 3]) for j in range(6)] for i in range(6)])
    assert np.array_equal(array(choose.median3(labels, KEYS, "label", 6, 6), "median", a.shape), want)


def test_identity_and_quarter_pixel_warp(spark):
    a = np.add.outer(np.arange(8) * 2.0, np.arange(8) * 3.0) + 1
    t = spark.createDataFrame([(0, 1.0, 0.0, 0.25, 0.0, 1.0, 0.0)], "stack int, a double, b double, c double, d double, e double, f double")
    w = geometry.warped(frame(spark, a), t, KEYS, "v", 8, 8)
    got = array(w, "v", a.shape)
    assert np.allclose(got[:, 1:], a[:, 1:] - 0.75) and not w.filter("x = 0 and valid").count()


def test_tiles_cover_once_and_halos_are_aligned(spark):
    g = tiles.grid(spark, 70, 90, 24, 5, 4)
    pixels = spark.range(70 * 90).select(F.lit(0).alias("stack"), F.expr("cast(id div 90 as int)").alias("y"), F.expr("cast(id % 90 as int)").alias("x"))
    rows = tiles.exchanged(pixels, g, 16)
    assert tiles.cropped(rows).count() == 70 * 90
    assert all(r.hy0 % 4 == 0 and r.hx0 % 4 == 0 for r in g.collect())


def test_orientations_are_permutations(spark):
    df = spark.range(12).select(F.expr("cast(id div 4 as int)").alias("y"), F.expr("cast(id % 4 as int)").alias("x"))
    for o in range(1, 9):
        y, x = pixel.oriented(F.col("y"), F.col("x"), 3, 4, o)
        assert df.select(y.alias("y"), x.alias("x")).distinct().count() == 12


def test_half_to_even_and_mirrors(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-3.0,), (70000.0,)], "v double")
    assert [r[0] for r in df.select(pixel.to_u16(F.col("v"))).collect()] == [0, 2, 2, 0, 65535]
    i = spark.range(-20, 20).select("id", pixel.reflect101(F.col("id"), 5).alias("m"))
    want = np.pad(np.arange(5), 20, mode="reflect")
    assert [r.m for r in i.orderBy("id").collect()] == want[:40].tolist()


def test_sizes(spark):
    df = spark.createDataFrame([("1.5GiB",), ("64M",), ("63M",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(listing.size_in_bytes(F.col("t"))).collect()] == [1610612736, 67108864, None, None, None]


def test_photographic_score_prefers_the_sharp_frame(spark):
    rng = np.random.default_rng(1)
    sharp = rng.integers(5000, 60000, (16, 16)).astype(float)
    soft = np.full((16, 16), sharp.mean())
    scores = [array(focus.photographic_score(frame(spark, a), KEYS, F.col("v"), 16, 16, 2), "score", a.shape).mean() for a in (sharp, soft)]
    assert scores[0] > 100 * max(scores[1], 1)
