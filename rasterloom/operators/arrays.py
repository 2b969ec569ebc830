"""The raster operators on whole blocks: NumPy kernels for tasks that hold a tile.

They follow the relational forms in ``focus``, ``choose`` and ``blend``; tests
hold both against one another.  A block has rows and columns in its last two
axes (planes of one kind come before) and keeps its precision (32 bits in whole
runs); borders mirror about the first and last place.

Every linear step along an axis is one of ``axis``'s tables.  Cut into runs of
``RUN`` output places it is a band of small dense matrices, so that a step is a
few matrix products, fast whatever the kernel's width.
"""

from __future__ import annotations

import functools
import math

import numpy as np

from rasterloom.functions.pixel import BLUE, GREEN, RED
from rasterloom.operators import axis, focus

FLOOR = 1e-8
RUN = 32


@functools.lru_cache(maxsize=256)
def _band(kind: str, n: int, weights: tuple, dtype: str) -> tuple[int, list[tuple[int, int, int, int, np.ndarray]]]:
    """How many places come out, and the runs: out from and to, in from and to, matrix."""
    table = {"around": lambda: axis.around(n, dict(weights)), "odd": lambda: axis.around(n, dict(weights), True), "halving": lambda: axis.halving(n), "doubling": lambda: axis.doubling(n)}[kind]()
    src, out, w = table[:, 0].astype(int), table[:, 1].astype(int), table[:, 2]
    size, runs = int(out[-1]) + 1, []
    cuts = np.searchsorted(out, np.arange(0, size + RUN, RUN)).tolist()
    for k, o0 in enumerate(range(0, size, RUN)):
        here = slice(cuts[k], cuts[k + 1])
        o1, i0, i1 = min(o0 + RUN, size), int(src[here].min()), int(src[here].max()) + 1
        m = np.zeros((o1 - o0, i1 - i0), dtype)
        m[out[here] - o0, src[here] - i0] = w[here]
        runs.append((o0, o1, i0, i1, m))
    return size, runs


def _applied(a: np.ndarray, dim: int, kind: str, n: int, weights: tuple = ()) -> np.ndarray:
    size, runs = _band(kind, n, weights, a.dtype.char)
    if dim == 0:
        out = np.empty((*a.shape[:-2], size, a.shape[-1]), a.dtype)
        for o0, o1, i0, i1, m in runs:
            np.matmul(m, a[..., i0:i1, :], out=out[..., o0:o1, :])
    else:
        out = np.empty((*a.shape[:-1], size), a.dtype)
        for o0, o1, i0, i1, m in runs:
            np.matmul(a[..., i0:i1], m.T, out=out[..., o0:o1])
    return out


def along(a: np.ndarray, weights: dict[int, float], dim: int) -> np.ndarray:
    """The weighted sum of the places around each, along rows (0) or columns (1); of the block's own precision."""
    return _applied(a, dim, "around", a.shape[dim - 2], tuple(weights.items())) if weights != axis.IDENTITY else a


def filtered(a: np.ndarray, vertical: dict[int, float], horizontal: dict[int, float]) -> np.ndarray:
    return along(along(a, vertical, 0), horizontal, 1)


def smooth(a: np.ndarray, radius: int) -> np.ndarray:
    k = axis.gaussian(radius)
    return filtered(a, k, k)


def grey(rgb: np.ndarray) -> np.ndarray:
    """Of three planes."""
    return rgb[0] * rgb.dtype.type(RED) + rgb[1] * rgb.dtype.type(GREEN) + rgb[2] * rgb.dtype.type(BLUE)


def sobel(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences first: where a block is flat they are exactly zero, and stay so."""
    return along(along(a, axis.RISE, 1), axis.BELL, 0), along(along(a, axis.RISE, 0), axis.BELL, 1)


def softened(a: np.ndarray, weights: dict[int, float], odd: int | None = None) -> np.ndarray:
    """A separable symmetric filter; ``odd``: the axis along which ``a`` is a derivative.  The derivative of a softened block is its softened derivative."""
    w = tuple(weights.items())
    for dim in (0, 1):
        a = _applied(a, dim, "odd" if dim == odd else "around", a.shape[dim - 2], w)
    return a


def energy(a: np.ndarray) -> np.ndarray:
    gx, gy = sobel(a)
    return gx * gx + gy * gy


def soft_energy(gx: np.ndarray, gy: np.ndarray, weights: dict[int, float]) -> np.ndarray:
    """The squared gradient of a softened block, from the gradient of the block."""
    gx, gy = softened(gx, weights, 1), softened(gy, weights, 0)
    return gx * gx + gy * gy


def standard_score(g: np.ndarray, radius: int, multiscale: bool = False) -> np.ndarray:
    gx, gy = sobel(g)
    fine = smooth(gx * gx + gy * gy, radius)
    return fine + 0.5 * smooth(soft_energy(gx, gy, axis.gaussian(3)), 2 * radius) if multiscale else fine


def structure(g: np.ndarray, radius: int, gradient: tuple[np.ndarray, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """``coherence`` of the gradient (squared), the ``noise`` floor, ``variance`` and ``contrast``."""
    gx, gy = gradient or sobel(g)
    mixed = filtered(g, axis.STEP, axis.STEP)
    xx, yy, xy, floor, mean, square = smooth(np.stack([gx * gx, gy * gy, gx * gy, mixed * mixed, g, g * g]), radius)
    trace = np.maximum(xx + yy, 1)
    coherence = ((xx - yy) ** 2 + 4 * xy**2) / (trace * trace)
    noise = 0.25 * floor * np.maximum(1 - coherence, 0)
    variance = np.maximum(square - mean * mean, 0)
    return {"coherence": coherence, "noise": noise, "variance": variance, "contrast": variance / (variance + 2 * noise + 1024)}


def photographic_score(g: np.ndarray, radius: int, best: bool) -> np.ndarray:
    """As ``focus.photographic_score``; what noise explains is taken off before the evidence is smoothed, which is the same."""
    gx, gy = sobel(g)
    bends = along(g, axis.SECOND, 0) + along(g, axis.SECOND, 1)
    s = structure(g, radius, (gx, gy))
    noise, total = s["noise"], np.zeros_like(g)
    for support, sigma, weight in focus.SCALES[: 3 if best else 2]:
        bell = focus.bell(support, sigma)
        explained = g.dtype.type(1.5 * focus.noise_gain(support, sigma)) * noise
        bend = softened(bends, bell)
        gain, bend = smooth(np.stack([soft_energy(gx, gy, bell) - explained, bend * bend]), focus.reach(support, radius))
        total += weight * (np.maximum(gain, 0) + 0.2 * np.maximum(bend - 0.5 * noise, 0))
    return total * s["contrast"]


class Best:
    """The three best scores of each pixel and their frames, as frames come by; -1 and frame 0 where there is none."""

    def __init__(self, shape: tuple[int, int], kind: type = np.float32):
        self.scores, self.frames = np.full((3, *shape), -1, kind), np.zeros((3, *shape), np.uint16)
        self.guide = np.zeros(shape, kind)

    def see(self, score: np.ndarray, frame: int, guide: np.ndarray) -> None:
        """A score that beats a place takes it, and what stood there goes on to the next one; ties leave the earlier frame."""
        self.guide = np.where(score > self.scores[0], guide, self.guide)
        s, f = score, np.full(score.shape, frame, np.uint16)
        for k in range(3):
            wins = s > self.scores[k]
            self.scores[k], s = np.where(wins, s, self.scores[k]), np.where(wins, self.scores[k], s)
            self.frames[k], f = np.where(wins, f, self.frames[k]), np.where(wins, self.frames[k], f)

    def confidence(self) -> np.ndarray:
        first, second = np.maximum(self.scores[0], 0), np.maximum(self.scores[1], 0)
        return np.clip((first - second) / np.maximum(first, FLOOR), 0, 1)

    def edge(self) -> np.ndarray:
        return np.minimum(np.hypot(*sobel(self.guide)) / 16000, 1)


def median3(a: np.ndarray) -> np.ndarray:
    """Of the 3 x 3 places around each; the border repeats."""
    wide = np.pad(a, 1, mode="edge")
    x, y, z = (wide[k : k + a.shape[0]] for k in range(3))
    low, high = np.minimum(x, y), np.maximum(x, y)
    least, most = np.minimum(low, z), np.maximum(high, z)  # of each column of three, sorted
    middle = np.maximum(low, np.minimum(high, z))
    three = lambda p: (p[:, :-2], p[:, 1:-1], p[:, 2:])

    def median(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        return np.maximum(np.minimum(p, q), np.minimum(np.maximum(p, q), r))

    return median(np.maximum.reduce(three(least)), median(*three(middle)), np.minimum.reduce(three(most)))


def cleaned(best: Best, confidence: np.ndarray, edge: np.ndarray | None) -> np.ndarray:
    """Weak labels replaced by the median; with an ``edge`` plane only off edges and by one of the three candidates."""
    label, median = best.frames[0], median3(best.frames[0])
    if edge is None:
        change = confidence < 0.25
    else:
        change = (confidence < 0.2) & (edge < 0.35) & ((best.frames == median) & (best.scores >= 0)).any(0)
    return np.where(change, median, label)


def eroded(valid: np.ndarray, support: int) -> np.ndarray:
    """Places all of whose square is valid; outside counts as valid."""
    if valid.all():
        return valid
    out = valid
    for dim in (0, 1):
        n = out.shape[dim]
        bad = np.concatenate([np.zeros_like(np.take(out, [0], dim), dtype=np.int64), np.cumsum(~out, axis=dim)], axis=dim)
        at = np.arange(n)
        out = np.take(bad, np.minimum(at + support + 1, n), dim) == np.take(bad, np.maximum(at - support, 0), dim)
    return out


def down(a: np.ndarray) -> np.ndarray:
    for dim in (0, 1):
        a = _applied(a, dim, "halving", a.shape[dim - 2])
    return a


def up(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """To h x w; borders mirror on the larger block."""
    return _applied(_applied(a, 0, "doubling", h), 1, "doubling", w)


def pyramid(a: np.ndarray, levels: int) -> list[np.ndarray]:
    """Laplacian levels, the last one the smallest block itself."""
    out = []
    for _ in range(levels):
        small = down(a)
        out.append(a - up(small, *a.shape[-2:]))
        a = small
    return [*out, a]


def collapsed(bands: list[np.ndarray]) -> np.ndarray:
    a = bands[-1]
    for band in reversed(bands[:-1]):
        a = band + up(a, *band.shape[-2:])
    return a


def to_u16(a: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(a), 0, 65535).astype(np.uint16)


def warped(block: np.ndarray, inverse: np.ndarray, box: tuple[int, int, int, int], at: tuple[int, int], size: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The places y0 to y1, x0 to x1 of the reference, bilinear, and which of them lie in the source.

    ``block`` begins at ``at`` in a source of ``size``; ``inverse`` maps reference places to source places.
    """
    y0, y1, x0, x1 = box
    y, x = np.arange(y0, y1, dtype=float)[:, None], np.arange(x0, x1, dtype=float)[None, :]
    sx = inverse[0, 0] * x + (inverse[0, 1] * y + inverse[0, 2])
    sy = inverse[1, 0] * x + (inverse[1, 1] * y + inverse[1, 2])
    slack = 1e-4
    valid = (sx >= -slack) & (sx <= size[1] - 1 + slack) & (sy >= -slack) & (sy <= size[0] - 1 + slack)
    h, w = block.shape[-2:]
    sy, sx = np.clip(sy - at[0], 0, h - 1), np.clip(sx - at[1], 0, w - 1)
    iy, ix = np.minimum(sy.astype(np.int64), max(h - 2, 0)), np.minimum(sx.astype(np.int64), max(w - 2, 0))
    fy, fx = (sy - iy).astype(block.dtype), (sx - ix).astype(block.dtype)
    first, right, below = iy * w + ix, int(w > 1), w * int(h > 1)
    planes = block.reshape(-1, h * w)
    out = np.empty((len(planes), *valid.shape), block.dtype)
    for plane, into in zip(planes, out):
        top = plane[first]
        top += (plane[first + right] - top) * fx
        low = plane[first + below]
        low += (plane[first + (below + right)] - low) * fx
        top += (low - top) * fy
        into[...] = top
    return out.reshape(*block.shape[:-2], *valid.shape), valid


def region(inverse: np.ndarray, box: tuple[int, int, int, int], size: tuple[int, int]) -> tuple[int, int, int, int] | None:
    """The part of the source that ``warped`` needs for a box, or None."""
    y0, y1, x0, x1 = box
    corners = np.array([[x, y, 1] for x in (x0, x1 - 1) for y in (y0, y1 - 1)], float) @ inverse.T
    (left, top), (right, bottom) = np.floor(corners.min(0)), np.ceil(corners.max(0))
    r = (max(0, int(top) - 2), min(size[0], int(bottom) + 3), max(0, int(left) - 2), min(size[1], int(right) + 3))
    return r if r[0] < r[1] and r[2] < r[3] else None


def inverted(m: np.ndarray) -> np.ndarray:
    a = np.linalg.inv(m[:, :2])
    return np.column_stack([a, -a @ m[:, 2]])


def rotation_degrees(m: np.ndarray) -> float:
    return math.degrees(math.atan2(m[1, 0], m[0, 0]))
