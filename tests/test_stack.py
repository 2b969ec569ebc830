"""Whole runs on small files."""

import dataclasses
import json
import types

import numpy as np
import pytest

from rasterloom import cli
from rasterloom.operators import arrays, layers
from rasterloom.plans import resources
from rasterloom.plans import stack as run
from rasterloom.plans.settings import Settings, size_in_bytes
from rasterloom.plans.tasks import Crew
from rasterloom.sources import frames, scenes, tiff, transcode
from rasterloom.sources.tiff import Refused

H, W = 97, 121


def smoothed(a, radius):
    """Of rows x columns x channels."""
    return arrays.smooth(a.astype(float).transpose(2, 0, 1), radius).transpose(1, 2, 0)


def saved(path, a, compression="none", meta=None):
    n = tiff.strip_rows(a.shape[1])
    with open(path, "wb") as f:
        tiff.write(f, [tiff.packed(a[y : y + n].astype("<u2").tobytes(), compression) for y in range(0, len(a), n)], *a.shape[:2], compression, meta or {})
    return str(path)


def loaded(path):
    head = tiff.header(str(path))
    return tiff.window(head, 0, head.shown[0], 0, head.shown[1])


@pytest.fixture(scope="module")
def scene():
    rng = np.random.default_rng(14)
    a = rng.integers(5000, 59000, (H, W, 3)).astype(float)
    return arrays.to_u16(smoothed(a, 4) * 3 - 64000)  # texture coarser than the noise of single pixels, which the scores discount


@pytest.fixture(scope="module")
def planes(scene):
    soft = arrays.to_u16(smoothed(scene, 9))
    left, right = soft.copy(), soft.copy()
    left[:, : W // 2], right[:, W // 2 :] = scene[:, : W // 2], scene[:, W // 2 :]
    return [left, right]


@pytest.mark.parametrize("quality", ["standard", "high", "max"])
def test_fuses_the_sharp_halves(spark, tmp_path, scene, planes, quality):
    paths = [saved(tmp_path / f"{k}.tif", p, c) for k, (p, c) in enumerate(zip(planes, ("none", "zlib")))]
    report = run.stack(spark, paths, tmp_path / "out.tif", Settings(quality=quality, alignment="none", tile_size=1024))
    whole = loaded(tmp_path / "out.tif")
    error = np.abs(whole.astype(int) - scene)
    assert error[:, : W // 2 - 12].mean() < 60 and error[:, W // 2 + 12 :].mean() < 60
    assert report.frames == 2 and report.shape == (H, W, 3) and json.dumps(report.as_dict())
    # tiles leave no seam
    run.stack(spark, paths, tmp_path / "tiled.tif", Settings(quality=quality, alignment="none", tile_size=48, compression="lzw"))
    assert np.abs(loaded(tmp_path / "tiled.tif").astype(int) - whole).max() <= 1


@pytest.mark.parametrize("n, quality, most", [(1, "standard", 0), (3, "standard", 0), (7, "standard", 0), (3, "max", 1), (20, "max", 1)])
def test_equal_frames_give_the_frame(spark, tmp_path, scene, n, quality, most):
    paths = [saved(tmp_path / f"{k}.tif", scene) for k in range(n)]
    run.stack(spark, paths, tmp_path / "out.tif", Settings(quality=quality, alignment="none"))
    assert np.abs(loaded(tmp_path / "out.tif").astype(int) - scene).max() <= most


@pytest.mark.parametrize("bright", [False, True])
def test_outlines_and_thin_strokes(spark, tmp_path, bright):
    truth, images, edges, thin = scenes.occlusion(bright)
    paths, errors = [saved(tmp_path / f"{k}.tif", a) for k, a in enumerate(images)], {}
    for quality in ("standard", "max"):
        run.stack(spark, paths, tmp_path / "out.tif", Settings(quality=quality, alignment="none", tile_size=128))
        tiled = loaded(tmp_path / "out.tif").astype(float)
        errors[quality] = (tiled - truth) ** 2
        run.stack(spark, paths, tmp_path / "one.tif", Settings(quality=quality, alignment="none", tile_size=512))
        assert np.abs(tiled - loaded(tmp_path / "one.tif")).max() <= 1
    assert errors["max"][edges].mean() < 0.9 * errors["standard"][edges].mean() and errors["max"].mean() < 0.9 * errors["standard"].mean()
    assert errors["max"][thin].max() <= 1


def test_noise_is_not_taken_for_focus(spark, tmp_path):
    rng = np.random.default_rng(22)
    sharp = scenes.band_rows(160, 200, 0, 1, 0, 160)
    soft = scenes.blurred(sharp.transpose(2, 0, 1), 2, 1.0).transpose(1, 2, 0)
    noisy = np.clip(soft + rng.normal(0, 7500, soft.shape), 0, 65535)
    paths, errors = [saved(tmp_path / f"{k}.tif", arrays.to_u16(a)) for k, a in enumerate((sharp.astype(float), noisy))], {}
    for quality in ("standard", "max"):
        run.stack(spark, paths, tmp_path / "out.tif", Settings(quality=quality, alignment="none"))
        errors[quality] = ((loaded(tmp_path / "out.tif").astype(float) - sharp) ** 2).mean()
    assert errors["max"] < 0.3 * errors["standard"]


def test_regions_that_cross(spark, tmp_path):
    sharp = scenes.band_rows(257, 321, 0, 1, 0, 257)
    soft = scenes.blurred(sharp.transpose(2, 0, 1), 8, 3.0).transpose(1, 2, 0)
    y, x = np.mgrid[0:257, 0:321]
    side = ((x - 160) * (y - 128) > 0)[..., None]
    paths = [saved(tmp_path / f"{k}.tif", np.where(s, sharp, soft)) for k, s in enumerate((side, ~side))]
    run.stack(spark, paths, tmp_path / "out.tif", Settings(quality="max", alignment="none", tile_size=96))
    away = (np.abs(x - 160) > 25) & (np.abs(y - 128) > 25)
    error = lambda a: ((a.astype(float) - sharp) ** 2)[away].mean()
    assert error(loaded(tmp_path / "out.tif")) < 0.01 * error(soft)


def test_frames_without_any_structure_stay_together(spark, tmp_path):
    a = np.full((91, 103, 3), 24000, np.uint16)
    paths = [saved(tmp_path / "0.tif", a), saved(tmp_path / "1.tif", a + 6000)]
    run.stack(spark, paths, tmp_path / "out.tif", Settings(quality="max", alignment="none", tile_size=32))
    assert np.array_equal(loaded(tmp_path / "out.tif"), a)


def test_more_than_255_frames():
    sharp = scenes.band_rows(32, 32, 0, 1, 0, 32).transpose(2, 0, 1).astype(np.float32)
    soft = scenes.blurred(sharp, 8, 3.0).astype(np.float32)
    read = lambda k, box: ((sharp if k == 256 else soft).copy(), np.ones((32, 32), bool))
    image = layers.both(read, 257, (0, 32, 0, 32), Settings(quality="max").rules, 256)
    assert np.array_equal(image[10:-10, 10:-10], sharp.transpose(1, 2, 0)[10:-10, 10:-10].astype(np.uint16))


def test_only_needed_frames_are_read_again(scene):
    asked = []

    def read(k, box):
        asked.append(k)
        return scene.transpose(2, 0, 1).astype(np.float32), np.ones(scene.shape[:2], bool)

    layers.both(read, 3, (0, H, 0, W), Settings(quality="max").rules, 2)
    assert asked == [0, 1, 2, 0]  # the first of equals; the reference is not needed as a fallback


def test_places_that_no_frame_covers_take_the_reference(scene):
    part = np.zeros((H, W), bool)
    part[:, :40] = True
    read = lambda k, box: (np.full((3, H, W), 100.0 + k, np.float32), part if k == 0 else np.zeros((H, W), bool))
    image = layers.both(read, 2, (0, H, 0, W), Settings().rules, 1)
    assert (image[:, :20] == 100).all() and (image[:, 60:] == 101).all()


def test_moved_frames_leave_no_seams(spark, tmp_path):
    sharp = scenes.blurred(scenes.hashed(0, 257, 0, 321), 6, 2.0)
    t = np.radians(2.2)
    m = np.array([[1.035 * np.cos(t), 1.035 * np.sin(t), 3.0], [-1.035 * np.sin(t), 1.035 * np.cos(t), -2.0]])
    moved = arrays.warped(sharp, m, (0, 257, 0, 321), (0, 0), (257, 321))[0]
    paths = [saved(tmp_path / f"{k}.tif", arrays.to_u16(a).transpose(1, 2, 0), c) for k, (a, c) in enumerate(((moved, "zlib"), (sharp, "none")))]
    out = []
    for side in (96, 512):
        report = run.stack(spark, paths, tmp_path / "out.tif", Settings(quality="max", reference=1, tile_size=side))
        out.append(loaded(tmp_path / "out.tif").astype(int))
    assert np.quantile(np.abs(out[0] - out[1]), 0.999) <= 2 and report.alignment[0]["inliers"] > 6 and report.alignment[0]["score"] > 0.8
    assert abs(report.alignment[0]["scale"] - 1.035) < 0.02 and abs(abs(report.alignment[0]["rotation_degrees"]) - 2.2) < 0.5


@pytest.mark.parametrize("where", ["choose", "merge", "pack", "place"])
@pytest.mark.parametrize("what", [KeyboardInterrupt, OSError])
def test_a_run_that_breaks_off_leaves_nothing(spark, tmp_path, planes, monkeypatch, where, what):
    paths = [saved(tmp_path / f"{k}.tif", p, "zlib") for k, p in enumerate(planes)]
    (tmp_path / "out.tif").write_bytes(b"what was there")

    def breaks(*_):
        raise what

    monkeypatch.setattr(run, where, breaks)
    with pytest.raises(what):
        run.stack(spark, paths, tmp_path / "out.tif", Settings(alignment="none", temp_dir=str(tmp_path / "between")))
    assert (tmp_path / "out.tif").read_bytes() == b"what was there" and not list((tmp_path / "between").iterdir())
    assert sorted(p.name for p in tmp_path.iterdir()) == ["0.tif", "1.tif", "between", "out.tif"]


def test_a_task_that_fails_is_named(spark, tmp_path, planes):
    paths = [saved(tmp_path / f"{k}.tif", p, "zlib") for k, p in enumerate(planes)]
    with open(paths[1], "r+b") as f:
        f.seek(2000)
        f.write(b"\xff" * 64)
    with pytest.raises(Refused):
        run.stack(spark, paths, tmp_path / "out.tif", Settings(alignment="none"))
    with pytest.raises(Refused, match="counting failed"):
        Crew(spark).run("counting", [1, 0], lambda k: 1 // k)


def test_report_and_progress(spark, tmp_path, planes):
    paths, seen = [saved(tmp_path / f"{k}.tif", p, "zlib") for k, p in enumerate(planes)], []
    report = run.stack(spark, paths, tmp_path / "out.tif", Settings(tile_size="auto", memory_budget="512M", quality="max", keep_temp=True), progress=lambda *s: seen.append(s)).as_dict()
    assert report["tile_size"] in resources.SIDES and report["budget_bytes"] <= 512 << 20 and report["peak_rss_bytes"] > 1 << 20 and report["scratch_bytes"] > H * W * 12
    assert {s for s, done, of in seen if done == of} >= {"decoding", "describing", "fitting", "choosing", "merging", "packing", "writing"} and set(report["timings"]) >= {"decoding", "alignment", "choosing", "merging", "packing", "writing"}
    import shutil

    shutil.rmtree(report["scratch_path"])


def test_memory_and_disk_are_looked_at_first(tmp_path, monkeypatch, scene):
    head = tiff.header(saved(tmp_path / "a.tif", scene, "zlib"))
    assert resources.budget("auto", 10 << 30) == 4 << 30 and resources.budget("8G", 1 << 30) == int(0.6 * (1 << 30))
    for side, text, free in ((2048, "512M", 8 << 30), ("auto", "auto", 200 << 20)):
        with pytest.raises(Refused, match="memory budget"):
            resources.allowed([head], Settings(quality="max", tile_size=side, memory_budget=text), tmp_path, tmp_path, free)
    huge = dataclasses.replace(head, h=8300, w=12000, seg_h=8300, seg_w=12000, counts=(580_000_000,))
    assert resources.allowed([huge], Settings(quality="max", tile_size="auto"), tmp_path, tmp_path, 12 << 30).tile == 2048
    with pytest.raises(Refused, match="segment"):
        resources.allowed([huge], Settings(quality="max", tile_size=512, memory_budget="1G"), tmp_path, tmp_path, 12 << 30)
    with pytest.raises(Refused, match="row of the output"):
        resources.allowed([dataclasses.replace(head, h=1, w=100_000_000, compression=1)], Settings(memory_budget="512M"), tmp_path, tmp_path, 12 << 30)
    monkeypatch.setattr(resources.shutil, "disk_usage", lambda _: types.SimpleNamespace(free=1000))
    with pytest.raises(Refused, match="disk"):
        resources.allowed([head], Settings(), tmp_path, tmp_path, 8 << 30)


def test_clean_pages_count_as_free(tmp_path):
    gib = 1 << 30
    (tmp_path / "memory.max").write_text("8589934592\n")
    (tmp_path / "memory.current").write_text(str(7 * gib))
    (tmp_path / "memory.stat").write_text(f"inactive_file {gib // 4}\nactive_file {gib // 2}\nfile_dirty {gib // 4}\nfile_writeback 0\n")
    assert resources.free_memory(tmp_path) == min(resources.free_memory(tmp_path / "none"), 8 * gib - 7 * gib + gib // 2)


@pytest.mark.parametrize("single", [False, True])
def test_transcoded(tmp_path, scene, single):
    source = saved(tmp_path / "a.tif", scene, meta={"icc": b"p", "artist": "x"})
    head = transcode.transcoded(source, tmp_path / "b.tif", "zlib", tile=32, single_strip=single)
    assert np.array_equal(loaded(tmp_path / "b.tif"), scene) and head.meta == {"icc": b"p", "artist": "x"}
    assert (head.seg_h, head.seg_w) == ((H, W) if single else (32, 32)) and not head.plain
    with pytest.raises(Refused):
        transcode.transcoded(source, source)


def test_grey_comes_from_the_decoding_pass(spark, tmp_path, monkeypatch):
    a = scenes.band_rows(150, 130, 0, 1, 0, 150)
    head = transcode.transcoded(saved(tmp_path / "a.tif", a), tmp_path / "b.tif", "lzw", tile=16)
    want = frames.reduced_grey(tiff.header(str(tmp_path / "a.tif")), 71)
    monkeypatch.setattr(frames, "UNPACK", 1 << 14)
    assert len(frames.bands(head)) > 2
    plain, plane = frames.plain_form(head, str(tmp_path / "0.raw"))
    plane.made()
    for y0, y1 in frames.bands(head):
        frames.unpacked(head, plane, y0, y1, 71)
    assert np.array_equal(tiff.window(plain, 0, 150, 0, 130), a)
    (tmp_path / "0.raw").unlink()  # reading it again would fail
    assert np.array_equal(frames.grey_of(plain, head, 71), want)


def test_aligns_and_keeps_what_describes_the_image(spark, tmp_path):
    rng = np.random.default_rng(3)
    big = arrays.to_u16(smoothed(rng.integers(0, 65536, (160, 200, 3)), 3))
    moved = arrays.warped(big.astype(float).transpose(2, 0, 1), np.array([[1, 0, 3.0], [0, 1, -2.0]]), (0, 160, 0, 200), (0, 0), (160, 200))[0].transpose(1, 2, 0)
    meta = {"icc": b"p", "resolution": [300.0, 240.0], "unit": 2, "artist": "a"}
    paths = [saved(tmp_path / "0.tif", arrays.to_u16(moved), meta={"icc": b"p"}), saved(tmp_path / "1.tif", big, meta=meta)]
    report = run.stack(spark, paths, tmp_path / "out.tif", Settings())
    assert np.allclose(np.array(report.transforms[0]), [[1, 0, 3], [0, 1, -2]], atol=0.1)
    assert tiff.header(str(tmp_path / "out.tif")).meta == meta


def test_frames_that_do_not_fit(spark, tmp_path, scene):
    a = saved(tmp_path / "a.tif", scene)
    b = saved(tmp_path / "b.tif", scene[:-1])
    c = saved(tmp_path / "c.tif", scene, meta={"icc": b"x"})
    blank = saved(tmp_path / "d.tif", np.full_like(scene, 30000))
    for paths, what in (([a, b], "size"), ([a, c], "profile"), ([a, str(tmp_path / "none.tif")], "no TIFF"), ([a, blank], "cannot be aligned")):
        with pytest.raises(Refused, match=what):
            run.stack(spark, paths, tmp_path / "out.tif", Settings())
    with pytest.raises(Refused, match="one of the inputs"):
        run.stack(spark, [a], a, Settings())
    assert not (tmp_path / "out.tif").exists()


def test_pixels_equal_the_window(spark, tmp_path, scene):
    head = tiff.header(saved(tmp_path / "a.tif", scene, "zlib"))
    rows = frames.pixels(spark, [head]).orderBy("y", "x").toPandas()
    assert np.array_equal(rows[["r", "g", "b"]].to_numpy().reshape(scene.shape), scene)


def test_settings():
    assert Settings().halo == 13 and Settings(multiscale=True).halo == 19 and Settings(quality="high").halo == 52 and Settings(quality="max").halo == 84
    for bad in (dict(tile_size=8), dict(quality="low"), dict(tile_overlap=3), dict(focus_radius=0), dict(compression="jpeg"), dict(memory_budget="1M"), dict(max_workers=0)):
        with pytest.raises(Refused):
            Settings(**bad).checked()
    assert size_in_bytes("1.5GiB") == 3 << 29 and size_in_bytes("auto") is None


def test_command_line(spark, tmp_path, planes):
    for k, p in enumerate(planes):
        saved(tmp_path / f"{k}.TIF", p)
    out, report = tmp_path / "o" / "out.tif", tmp_path / "r" / "report.json"
    assert cli.main([str(tmp_path), "-o", str(out), "--alignment", "none", "--report-json", str(report)]) == 0
    assert json.loads(report.read_text())["frames"] == 2 and loaded(out).shape == planes[0].shape
    assert cli.main([str(tmp_path), "-o", str(out), "--report-json", str(out)]) == 2
    assert cli.main([str(tmp_path / "missing"), "-o", str(out)]) == 2
