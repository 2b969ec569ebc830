"""Frames as a data source."""

import numpy as np
import pytest

from rasterloom.sources import scenes, source, tiff, transcode


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    place = tmp_path_factory.mktemp("frames")
    for k in range(4):
        scenes.band_frame(place / f"{k}.tif", 150, 130, k, 4, meta={"icc": b"p"})
    transcode.transcoded(place / "3.tif", place / "4.tif", "lzw", tile=64)
    (place / "notes.txt").write_text("not a frame")
    return place


def test_frames(spark, folder):
    source.register(spark)
    rows = spark.read.format("rasterloom").load(str(folder)).orderBy("frame").collect()
    assert [(r.frame, r.h, r.w, r.depth, r.packed, bytes(r.icc)) for r in rows] == [(k, 150, 130, 16, k == 4, b"p") for k in range(5)]
    assert spark.read.format("rasterloom").load(str(folder)).filter("frame >= 2 and frame < 4").count() == 2


def test_blocks(spark, folder):
    source.register(spark)
    df = spark.read.format("rasterloom").option("form", "blocks").option("side", 64).load(str(folder))
    for k in (1, 4):
        whole = np.zeros((150, 130, 3), np.uint16)
        for r in df.filter(f"frame = {k}").collect():
            whole[r.y0 : r.y1, r.x0 : r.x1] = np.frombuffer(r.data, "<u2").reshape(r.y1 - r.y0, r.x1 - r.x0, 3)
        head = tiff.header(str(folder / f"{k}.tif"))
        assert np.array_equal(whole, tiff.window(head, 0, 150, 0, 130))
    box = df.filter("frame in (0, 2) and y0 < 100 and y1 > 70 and x0 >= 64")
    assert sorted((r.frame, r.y0, r.x0) for r in box.collect()) == [(k, 64, x) for k in (0, 2) for x in (64, 128)]


def test_bands_outside_a_filter_are_not_read(folder):
    reader = source.RasterReader("blocks", [str(folder / f"{k}.tif") for k in range(5)], 64)
    pushed = [source.In(("frame",), (0, 2)), source.LessThan(("y0",), 100), source.GreaterThan(("y1",), 70), source.GreaterThanOrEqual(("x0",), 64)]
    assert list(reader.pushFilters(pushed)) == pushed
    parts = reader.partitions()
    assert [(list(p.numbers), p.y0) for p in parts] == [([0], 64), ([2], 64)]
    assert [b.column(3).to_pylist() for b in reader.read(parts[0])] == [[64], [128]]


def test_unknown_forms_are_refused(spark, folder):
    source.register(spark)
    with pytest.raises(Exception, match="frames or blocks"):
        spark.read.format("rasterloom").option("form", "pixels").load(str(folder)).count()
