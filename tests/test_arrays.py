"""Block kernels against the relational operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import arrays, blend, focus

KEYS = ["stack"]


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(5).integers(0, 65536, (13, 10)).astype(float)


@pytest.fixture(scope="module")
def rows(spark, image):
    h, w = image.shape
    return spark.createDataFrame([(0, y, x, float(image[y, x])) for y in range(h) for x in range(w)], "stack int, y int, x int, v double")


def block(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.y, r.x] = r[name]
    return out


def test_photographic_score(rows, image):
    got = block(focus.photographic_score(rows, KEYS, F.col("v"), 13, 10, 2, True), "score", image.shape)
    assert np.allclose(got, arrays.photographic_score(image, 2, True), rtol=1e-9, atol=1e-3)


def test_standard_score(rows, image):
    got = block(focus.standard_score(rows, KEYS, F.col("v"), 13, 10, 2, True), "score", image.shape)
    assert np.allclose(got, arrays.standard_score(image, 2, True))


@pytest.mark.parametrize("shape", [(13, 10), (8, 8), (5, 1), (1, 2)])
def test_pyramid_steps(spark, shape):
    a = np.random.default_rng(1).random(shape)
    df = spark.createDataFrame([(0, y, x, float(a[y, x])) for y in range(shape[0]) for x in range(shape[1])], "stack int, y int, x int, v double")
    small = arrays.down(a)
    less = blend.down(df, KEYS, "v", *shape)
    assert np.allclose(block(less, "v", small.shape), small)
    assert np.allclose(block(blend.up(less, KEYS, "v", *shape), "v", shape), arrays.up(small, *shape))
    assert np.allclose(arrays.collapsed(arrays.pyramid(a, 3)), a)


def test_best_hops_past_ties():
    best = arrays.Best((1, 1))
    for frame, score in enumerate([7.0, 7.0, 7.0, 9.0]):
        best.see(np.full((1, 1), score), frame, np.zeros((1, 1)))
    assert best.frames.ravel().tolist() == [3, 1, 2] and best.scores.ravel().tolist() == [9, 7, 7]


def test_erosion_takes_the_outside_as_valid():
    valid = np.ones((6, 7), bool)
    valid[2, 3] = False
    out = arrays.eroded(valid, 1)
    assert out.sum() == 42 - 9 and not out[1:4, 2:5].any()


def test_warp_of_a_shift_is_exact():
    y, x = np.mgrid[0:16, 0:16]
    m = np.array([[1, 0, 0.25], [0, 1, -0.5]])
    got, valid = arrays.warped(3.0 * x + 2 * y, arrays.inverted(m), (4, 8, 4, 8), (0, 0), (16, 16))
    want = 3 * (x[4:8, 4:8] - 0.25) + 2 * (y[4:8, 4:8] + 0.5)
    assert valid.all() and np.allclose(got, want)
