"""Blocks with a halo against the whole raster."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import arrays, axis, blocks, focus, layers
from rasterloom.plans.settings import Settings

H, W = 75, 90


@pytest.fixture(scope="module")
def images():
    return np.random.default_rng(5).integers(0, 65536, (3, H, W)).astype(float)


@pytest.fixture(scope="module")
def rows(spark, images):
    import pandas as pd

    y, x = np.mgrid[0:H, 0:W]
    whole = pd.concat([pd.DataFrame({"stack": f"s{k % 2}", "frame": k, "y": y.ravel(), "x": x.ravel(), "v": a.ravel()}) for k, a in enumerate(images)])
    return spark.createDataFrame(whole.sample(frac=1, random_state=1), "stack string, frame int, y int, x int, v double").repartition(4)


def planes(df, names, shape=(H, W)):
    out = {}
    for key, own in df.toPandas().groupby(names):
        a = np.full(shape, np.nan)
        a[own.y, own.x] = own.iloc[:, -1]
        out[key] = a
    return out


@pytest.mark.parametrize("side", [16, 40, 512])
def test_blocks_equal_the_whole(rows, images, side):
    got = blocks.by_block(rows, ["stack", "frame"], ["v"], H, W, 14, lambda b: {"s": arrays.photographic_score(b["v"], 3, True)}, {"s": "double"}, side=side)
    found = planes(got, ["stack", "frame"])
    assert len(found) == 3
    for (_, k), a in found.items():
        want = arrays.photographic_score(images[k], 3, True)
        assert np.allclose(a, want, rtol=1e-9, atol=1e-3 * 1e6)


def test_levels(rows, images):
    kernel = lambda b: [{"v": p} for p in arrays.pyramid(b["v"], 3)]
    got = blocks.by_block(rows, ["stack", "frame"], ["v"], H, W, 4 * 7, kernel, {"v": "double"}, side=24, grid=8, levels=True).toPandas()
    for k in range(3):
        for level, want in enumerate(arrays.pyramid(images[k], 3)):
            own = got[(got.frame == k) & (got.level == level)]
            a = np.full(want.shape, np.nan)
            a[own.y, own.x] = own.v
            assert np.allclose(a, want)


def test_frames_of_a_raster(rows, images):
    rules = Settings(quality="high").rules

    def kernel(b):
        read = lambda k, box: (np.repeat(b["v"][k][None], 3, 0), np.ones(b["v"][k].shape, bool))
        box = b.box
        return {"v": layers.both(read, len(b.frames), box, rules, 0)[None, ..., 0]}

    got = planes(blocks.by_block(rows.filter("stack = 's0'"), ["stack"], ["v"], H, W, Settings(quality="high").halo, kernel, {"v": "int"}, side=32, grid=8, frame="frame"), "stack")
    read = lambda k, box: (np.repeat(images[2 * k][None], 3, 0), np.ones((H, W), bool))
    want = layers.both(read, 2, (0, H, 0, W), rules, 0)[..., 0]
    assert np.abs(got["s0"] - want).max() <= 1


def test_gaps_are_refused(rows):
    with pytest.raises(Exception, match="not dense"):
        blocks.by_block(rows.filter("y + x != 20"), ["stack", "frame"], ["v"], H, W, 0, lambda b: {"v": b["v"]}, {"v": "double"}).count()


def test_odd_mirrors_make_softened_derivatives():
    a = np.random.default_rng(2).random((9, 7))
    for n in (1, 2, 5, 9):
        b = a[:n, :n]
        bell = focus.bell(6, 2.0)
        soft = arrays.filtered(b, bell, bell)
        gx, gy = arrays.sobel(b)
        want = arrays.sobel(soft)
        assert np.allclose(arrays.softened(gx, bell, 1), want[0]) and np.allclose(arrays.softened(gy, bell, 0), want[1])
        second = lambda p: arrays.along(p, axis.SECOND, 0) + arrays.along(p, axis.SECOND, 1)
        assert np.allclose(arrays.softened(second(b), bell), second(soft))


def test_empty_rasters(spark):
    none = spark.createDataFrame([], "stack int, y int, x int, v double")
    assert blocks.by_block(none, ["stack"], ["v"], 8, 8, 1, lambda b: {"v": b["v"]}, {"v": "double"}).count() == 0
    assert F is not None
