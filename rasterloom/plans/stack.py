"""A whole run: files in, one file out that is sharp wherever some frame is.

A run is a chain of jobs over items that the driver lists (headers, bands of
packed frames, frames, windows, runs of strips); what tasks make lies in plain
files of a shared folder, written at places that are known beforehand, so a task
that is lost is simply run again and no pixel passes through the driver or a
shuffle.  A task reads only its window, frame by frame: memory does not grow
with the number of frames.  Inputs, output and ``temp_dir`` are mounted by all
executors.
"""

from __future__ import annotations

import os
import pickle
import shutil
import tempfile
import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

from rasterloom.operators import arrays, layers, register
from rasterloom.operators.layers import Box
from rasterloom.plans import resources
from rasterloom.plans.settings import Settings
from rasterloom.plans.tasks import Crew
from rasterloom.sources import frames, scratch, tiff
from rasterloom.sources.planes import Plane, copied
from rasterloom.sources.tiff import Header, Refused

#: Side of the windows in which frames are chosen, at most: small enough for a core's cache.
CHOOSE = 512
#: Bytes of output that a packing task has, about.
PACK = 4 << 20


@dataclass(frozen=True)
class Report:
    output: str
    shape: tuple[int, int, int]
    frames: int
    elapsed_seconds: float
    peak_rss_bytes: int
    budget_bytes: int
    scratch_bytes: int
    output_bytes: int
    input_bytes: int
    tile_size: int
    transforms: list
    alignment: list
    timings: dict
    scratch_path: str | None

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass
class Clock:
    """Seconds of each stage, told to a log as it ends."""

    log: Callable[[str], None]
    began: float = field(default_factory=time.perf_counter)
    seconds: dict[str, float] = field(default_factory=dict)

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        start = time.perf_counter()
        yield
        self.seconds[name] = round(time.perf_counter() - start, 3)
        self.log(f"{name}: {self.seconds[name]} s")

    @property
    def elapsed(self) -> float:
        return round(time.perf_counter() - self.began, 3)


def cores_of(h: int, w: int, side: int, least: int, grid: int = 1) -> list[Box]:
    """The image in windows of ``side`` at most, as many as ``least`` if it is large enough, that begin at multiples of ``grid``."""
    down, across = -(-h // side), -(-w // side)
    while down * across < least and max(-(-h // down), -(-w // across)) > max(64, 2 * grid):
        if h / down > w / across:
            down += 1
        else:
            across += 1
    cuts = lambda n, parts: sorted({min(n, round(n * k / parts / grid) * grid) for k in range(parts)} | {n})
    ys, xs = cuts(h, down), cuts(w, across)
    return [(y0, y1, x0, x1) for y0, y1 in zip(ys, ys[1:]) for x0, x1 in zip(xs, xs[1:])]


def widened(core: Box, halo: int, h: int, w: int, grid: int = 1) -> Box:
    """A core with all that its filters look at; begins at multiples of ``grid``."""
    y0, y1, x0, x1 = core
    low, high = lambda v: max(0, v - halo) // grid * grid, lambda v, n: min(-(-(v + halo) // grid) * grid, n)
    return low(y0), high(y1, h), low(x0), high(x1, w)


def within(core: Box, window: Box) -> tuple[slice, slice]:
    return slice(core[0] - window[0], core[1] - window[0]), slice(core[2] - window[2], core[3] - window[2])


def reader(held) -> layers.Read:
    """held: a broadcast of all headers and matrices.  Windows of the files, each moved by its frame's matrix."""

    def planes(head: Header, box: Box) -> np.ndarray:
        return tiff.window(head, *box).transpose(2, 0, 1).astype(np.float32, order="C")

    def read(k: int, box: Box) -> tuple[np.ndarray, np.ndarray]:
        heads, matrices = held.value
        head, m, shape = heads[k], matrices[k], (box[1] - box[0], box[3] - box[2])
        if np.array_equal(m, register.IDENTITY):
            return planes(head, box), np.ones(shape, bool)
        inverse = arrays.inverted(m)
        part = arrays.region(inverse, box, head.shown)
        if part is None:
            return np.zeros((3, *shape), np.float32), np.zeros(shape, bool)
        return arrays.warped(planes(head, part), inverse, box, (part[0], part[2]), head.shown)

    return read


def checked_headers(spark: SparkSession, paths: list[str]) -> list[Header]:
    rows = sorted(frames.headers(spark, paths).collect(), key=lambda r: r.frame)
    for r in rows:
        if r.reason:
            raise Refused(r.reason)
        for what, name in (("h", "size"), ("w", "size"), ("depth", "depth"), ("icc", "profile")):
            if r[what] != rows[0][what]:
                raise Refused(f"{r.path}: {name} differs from {rows[0].path}")
    return [pickle.loads(r.header) for r in rows]


def plainly(crew: Crew, heads: list[Header], folder: str, bound: int | None) -> list[Header]:
    """Frames whose rows cannot be read where they lie, decoded once into plain files; a task for each band of segments."""
    forms = {k: frames.plain_form(head, f"{folder}/{k}.raw") for k, head in enumerate(heads) if not head.plain}
    for _, plane in forms.values():
        plane.made()
    items = [(head, forms[k][1], y0, y1) for k, head in enumerate(heads) if k in forms for y0, y1 in frames.bands(head)]
    crew.run("decoding", items, lambda i: frames.unpacked(*i, bound))
    return [forms[k][0] if k in forms else head for k, head in enumerate(heads)]


def aligned(crew: Crew, ready: list[Header], heads: list[Header], reference: int, settings: Settings, folder: str) -> list[register.Fit]:
    """Each frame is reduced and searched for features once, in a task of its own; then each is fitted to the reference in one."""
    n, bound, mode, shown = len(heads), settings.analysis_bound, settings.alignment, heads[reference].shown
    if mode == "none" or n == 1:
        return [register.Fit(register.IDENTITY, 1.0, "disabled" if mode == "none" else "reference")] * n
    place = lambda k: f"{folder}/look-{k}.pickle"

    def describe(item: tuple[int, Header, Header]) -> None:
        k, plain, packed = item
        own = f"{place(k)}.{os.getpid()}.{os.urandom(4).hex()}"
        with open(own, "wb") as f:
            pickle.dump(register.look(frames.grey_of(plain, packed, bound)), f)
        os.replace(own, place(k))

    def fit(k: int) -> register.Fit:
        looks = []
        for one in (reference, k):
            with open(place(one), "rb") as f:
                looks.append(pickle.load(f))
        try:
            found = register.fitted(*looks, mode)
            m = register.rescaled(found.matrix, looks[0].shape, shown)
            why = register.reason(m, *shown)
            if why:
                raise Refused(why)
        except Refused as e:
            raise Refused(f"frame {k} ({Path(heads[k].path).name}) cannot be aligned: {e}") from e
        return replace(found, matrix=m, details={**found.details, "translation": m[:, 2].tolist()})

    crew.run("describing", list(zip(range(n), ready, heads)), describe)
    others = [k for k in range(n) if k != reference]
    fits = dict(zip(others, crew.run("fitting", others, fit)))
    return [fits.get(k) or register.Fit(register.IDENTITY, 1.0, "reference") for k in range(n)]


def choose(crew: Crew, read: layers.Read, n: int, label: Plane, sure: Plane, settings: Settings) -> None:
    """The first pass over all places."""
    h, w, rules = label.h, label.w, settings.rules
    halo = settings.focus_support + settings.reaches["clean-up"]

    def work(core: Box) -> None:
        window = widened(core, halo, h, w)
        at = within(core, window)
        for plane, values in zip((label, sure), layers.chosen(read, range(n), window, rules)):
            plane.write(core[0], core[2], values[at])

    side = CHOOSE if settings.tile_size >= CHOOSE else settings.tile_size
    crew.run("choosing", cores_of(h, w, side, 3 * crew.cores), work)


def merge(crew: Crew, read: layers.Read, label: Plane, sure: Plane, into: Plane, settings: Settings, reference: int) -> None:
    """The second pass: tiles of the result, each from the frames that it was given."""
    h, w, rules = label.h, label.w, settings.rules

    def work(core: Box) -> None:
        window = widened(core, settings.halo, h, w, settings.grid)
        tile = layers.merged(read, label.read(*window), sure.read(*window), window, rules, reference)
        into.write(core[0], core[2], tile[within(core, window)])

    crew.run("merging", cores_of(h, w, settings.tile_size, crew.cores, settings.grid), work)


def pack(crew: Crew, image: Plane, folder: str, compression: str) -> list[tuple[str, list[int]]]:
    """The image as packed strips, runs of them in files of their own: path and sizes."""
    rows = tiff.strip_rows(image.w)
    count = -(-image.h // rows)
    step = max(1, min(PACK // (rows * image.w * 6), -(-count // crew.cores)))

    def work(first: int) -> tuple[str, list[int]]:
        path, sizes = f"{folder}/strips-{first}", []
        own = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
        with open(own, "wb") as f:
            for k in range(first, min(first + step, count)):
                data = tiff.packed(image.read(k * rows, min((k + 1) * rows, image.h), 0, image.w).tobytes(), compression)
                sizes.append(len(data))
                f.write(data)
        os.replace(own, path)
        return path, sizes

    return crew.run("packing", list(range(0, count, step)), work)


def place(crew: Crew, parts: list[tuple[str, list[int]]], image: Plane, target: str, compression: str, meta: dict) -> None:
    """Packed strips copied by tasks to where prefix sums of their sizes say, read back and held against the image; the driver adds what stands around them."""
    big, rows = tiff.big_file(image.h, image.w), tiff.strip_rows(image.w)
    start = len(tiff.preamble(big))
    counts = [n for _, sizes in parts for n in sizes]
    offsets = (start + np.cumsum(counts) - counts).tolist()
    tail, here = tiff.directory(start + sum(counts), offsets, counts, image.h, image.w, compression, meta, big)
    with open(target, "r+b") as f:
        f.truncate(start + sum(counts))
        f.write(tiff.preamble(big))
        f.seek(0, os.SEEK_END)
        f.write(tail)
        at, value = tiff.pointer(big, here)
        f.seek(at)
        f.write(value)
    firsts = np.cumsum([0, *[len(sizes) for _, sizes in parts]]).tolist()

    def work(item: tuple[str, int, int]) -> None:
        path, a, b = item
        copied(path, 0, sum(counts[a:b]), target, offsets[a])
        head = tiff.header(target)
        with open(target, "rb") as f:
            for k in range(a, b):
                if not np.array_equal(tiff.segment(f, head, k), image.read(k * rows, min((k + 1) * rows, image.h), 0, image.w)):
                    raise Refused(f"{target}: strip {k} is not as it should be")

    crew.run("writing", [(path, a, b) for (path, _), a, b in zip(parts, firsts, firsts[1:])], work)


@contextmanager
def beside(output: Path) -> Iterator[str]:
    """A file next to the output, which takes its place at the end; whatever goes wrong, only the old output or the whole new one is there."""
    handle, path = tempfile.mkstemp(prefix=f".{output.name}.", suffix=".tmp", dir=output.parent)
    os.close(handle)
    try:
        yield path
        for at, mode in ((path, os.O_RDWR), (output.parent, os.O_RDONLY)):
            f = os.open(at, mode)
            try:
                os.fsync(f)
            finally:
                os.close(f)
            if at == path:
                os.replace(path, output)
    finally:
        if os.path.exists(path):
            os.remove(path)


@contextmanager
def workplace(spark: SparkSession, settings: Settings) -> Iterator[str]:
    """A folder of the run's own in ``temp_dir``, else in what the cluster names in ``spark.checkpoint.dir``."""
    folder = shared_folder(spark, settings)
    try:
        yield folder
    finally:
        if not settings.keep_temp:
            shutil.rmtree(folder, ignore_errors=True)


def shared_folder(spark: SparkSession, settings: Settings) -> str:
    base = str(settings.temp_dir or scratch.folder(spark)).removeprefix("file://").removeprefix("file:")
    if "://" in base:
        raise Refused(f"{base}: give a temp_dir that all executors have mounted")
    os.makedirs(base, exist_ok=True)
    return tempfile.mkdtemp(prefix="stack-", dir=base)


def stack(
    spark: SparkSession, inputs: Sequence[str | Path], output: str | Path, settings: Settings | None = None,
    log: Callable[[str], None] | None = None, progress: Callable[[str, int, int], None] | None = None,
) -> Report:
    """Merge the frames ``inputs`` into ``output``.  ``progress`` is told each stage, and how many of its items are done of how many."""
    settings, clock, crew = (settings or Settings.given()).checked(), Clock(log or (lambda _: None)), Crew(spark, progress)
    paths, output = frames.discovered(inputs), Path(output).expanduser().resolve()
    if str(output) in paths:
        raise Refused("the output is one of the inputs")
    with clock.stage("headers"):
        heads = checked_headers(spark, paths)
    n, (h, w) = len(heads), heads[0].shown
    reference = n // 2 if settings.reference is None else settings.reference
    if not 0 <= reference < n:
        raise Refused(f"the reference is one of 0 to {n - 1}")
    output.parent.mkdir(parents=True, exist_ok=True)
    with workplace(spark, settings) as folder:
        plan = resources.allowed(heads, settings, folder, output.parent)
        settings = replace(settings, tile_size=plan.tile)
        clock.log(f"{n} frames of {w} x {h}, tile {plan.tile}, halo {settings.halo}, budget {plan.budget >> 20} MiB, {plan.scratch >> 20} MiB between and {plan.output >> 20} MiB of output")
        with clock.stage("decoding"):
            ready = plainly(crew, heads, folder, settings.analysis_bound if settings.alignment != "none" and n > 1 else None)
        with clock.stage("alignment"):
            fits = aligned(crew, ready, heads, reference, settings, folder)
        read = reader(spark.sparkContext.broadcast((ready, [f.matrix for f in fits])))
        label, sure, image = Plane(f"{folder}/label", h, w, "<u2").made(), Plane(f"{folder}/sure", h, w, "<f4").made(), Plane(f"{folder}/image", h, w, "<u2", 3).made()
        with clock.stage("choosing"):
            choose(crew, read, n, label, sure, settings)
        with clock.stage("merging"):
            merge(crew, read, label, sure, image, settings, reference)
        with beside(output) as target:
            with clock.stage("packing"):
                parts = pack(crew, image, folder, settings.compression)
            with clock.stage("writing"):
                place(crew, parts, image, target, settings.compression, heads[reference].meta)
        used = sum(f.stat().st_size for f in Path(folder).rglob("*") if f.is_file())
    return Report(
        str(output), (h, w, 3), n, clock.elapsed, crew.peak, plan.budget, used, output.stat().st_size, sum(os.path.getsize(p) for p in paths), plan.tile,
        [f.matrix.tolist() for f in fits], [{"score": f.score, "method": f.method, **f.details} for f in fits], clock.seconds, folder if settings.keep_temp else None,
    )
