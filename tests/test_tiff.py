"""TIFF files: round trips, windows, refusals."""

import io
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.sources import tiff


def saved(path, a, compression="zlib", meta=None, big=None):
    h, w, _ = a.shape
    n = tiff.strip_rows(w)
    with open(path, "wb") as f:
        tiff.write(f, (tiff.packed(a[y : y + n].astype("<u2").tobytes(), compression) for y in range(0, h, n)), h, w, compression, meta or {}, big)
    return tiff.header(str(path))


def handmade(path, a, order="<", tile=None, rows=None, orientation=1, predictor=1, compression=1, **other):
    """A file by another writer: either byte order, tiles, 8 bits, differences."""
    h, w, _ = a.shape
    th, tw = tile or (rows or h, w)
    parts = []
    for y in range(0, h, th):
        for x in range(0, w, tw):
            p = np.zeros((th if tile else min(th, h - y), tw, 3), a.dtype)
            q = a[y : y + th, x : x + tw]
            p[: q.shape[0], : q.shape[1]] = q
            if predictor == 2:
                p = np.concatenate([p[:, :1], np.diff(p, axis=1)], axis=1)
            raw = p.astype(p.dtype.newbyteorder(order)).tobytes()
            parts.append(zlib.compress(raw) if compression == 8 else raw)
    tags = {256: [w], 257: [h], 258: [a.dtype.itemsize * 8] * 3, 259: [compression], 262: [2], 274: [orientation], 277: [3], 284: [1], 317: [predictor]}
    tags |= {322: [tw], 323: [th], 324: [], 325: []} if tile else {273: [], 278: [th], 279: []}
    tags |= {int(k[1:]): v for k, v in other.items()}
    body, at = b"", 8
    for p in parts:
        tags[324 if tile else 273].append(at + len(body))
        tags[325 if tile else 279].append(len(p))
        body += p
    entries, start = b"", at + len(body) + 2 + 12 * len(tags) + 4
    more = b""
    for code in sorted(tags):
        raw = struct.pack(f"{order}{len(tags[code])}I", *tags[code])
        entries += struct.pack(order + "HHI", code, 4, len(tags[code])) + (raw if len(raw) <= 4 else struct.pack(order + "I", start + len(more)))
        more += raw if len(raw) > 4 else b""
    with open(path, "wb") as f:
        f.write(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, at + len(body)) + body + struct.pack(order + "H", len(tags)) + entries + bytes(4) + more)
    return tiff.header(str(path))


@pytest.fixture
def image():
    return np.random.default_rng(2).integers(0, 65536, (37, 29, 3)).astype(np.uint16)


@pytest.mark.parametrize("compression", ["none", "zlib", "lzw", "zstd"])
@pytest.mark.parametrize("big", [False, True])
def test_round_trip(tmp_path, image, compression, big):
    meta = {"icc": b"profile", "resolution": [300.0, 240.5], "unit": 2, "artist": "someone", "description": "a scene"}
    head = saved(tmp_path / "a.tif", image, compression, meta, big)
    assert np.array_equal(tiff.window(head, 0, 37, 0, 29), image)
    assert np.array_equal(tiff.window(head, 5, 30, 3, 17), image[5:30, 3:17])
    assert head.meta == meta


@pytest.mark.parametrize("options", [{"order": ">"}, {"tile": (16, 16)}, {"rows": 5, "order": ">", "compression": 8}, {"tile": (16, 32), "predictor": 2, "compression": 8}, {"rows": 7, "predictor": 2}])
def test_other_layouts(tmp_path, image, options):
    for a in (image, (image >> 8).astype(np.uint8)):
        head = handmade(tmp_path / "b.tif", a, **options)
        want = a if a.dtype == np.uint16 else a.astype(np.uint16) * 257
        assert np.array_equal(tiff.window(head, 0, 37, 0, 29), want)
        assert np.array_equal(tiff.window(head, 11, 34, 9, 28), want[11:34, 9:28])


@pytest.mark.parametrize("orientation", range(1, 9))
def test_orientation(tmp_path, image, orientation):
    from rasterloom.functions import pixel
    from rasterloom.sources import tiff as t

    head = handmade(tmp_path / "c.tif", image, orientation=orientation, rows=6)
    shown = t.turned(image, orientation)
    assert head.shown == shown.shape[:2]
    assert np.array_equal(t.window(head, 4, 25, 2, 20), shown[4:25, 2:20])
    y, x = pixel.oriented(5, 3, 37, 29, orientation)
    assert np.array_equal(shown[y, x], image[5, 3])


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=3000), st.integers(1, 20000).map(lambda n: bytes(i * i % 7 for i in range(n)))))
def test_lzw(data):
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_long_lzw_clears_its_table():
    data = np.random.default_rng(0).integers(0, 256, 40000).astype(np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


@pytest.mark.parametrize("other", [{"t262": [1]}, {"t277": [4]}, {"t284": [2]}, {"t274": [9]}, {"t258": [12] * 3}, {"t330": [8]}, {"t339": [3] * 3}, {"t259": [7]}])
def test_refusals(tmp_path, image, other):
    with pytest.raises(tiff.Refused):
        handmade(tmp_path / "d.tif", image, **other)


def test_cut_and_foreign_files(tmp_path, image):
    saved(tmp_path / "e.tif", image)
    raw = (tmp_path / "e.tif").read_bytes()
    for bad in (raw[:200], b"II*\0" + b"\0" * 20, b"hello", b""):
        (tmp_path / "f.tif").write_bytes(bad)
        with pytest.raises(tiff.Refused):
            tiff.header(str(tmp_path / "f.tif"))
