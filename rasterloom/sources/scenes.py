"""Synthetic frames: a hashed texture sharp in one band of each frame, and a scene in which near things hide far ones."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np

from rasterloom.operators import arrays, focus
from rasterloom.sources import tiff

# The texture's multipliers, its range, and the kernels (reach, sigma) that make it and put it out of focus.
MULTIPLIERS, LEAST, RANGE = (374761393, 668265263, 1274126177), 5000, 55000
GRAIN, BLUR = (1, 0.65), (8, 3.0)

# Fixed values of the occlusion scene: size and seed; for a dark and a bright foreground the ground's range and the foreground's
# colour; disc (x, y, radius); strokes (from, to, thickness); kernels of the ground, of what lies behind, and of what lies before.
SCENE_SIZE, SCENE_SEED = (257, 321), 81
GROUND = {False: (33000, 49000), True: (3000, 17000)}
COLOUR = {False: (2500, 4200, 1800), True: (58000, 54000, 61000)}
DISC = (130, 120, 45)
STROKES = [((40, 30), (265, 225), 2), ((285, 25), (30, 220), 1), ((90, 20), (90, 230), 2)]
SOIL, BEHIND, BEFORE = (1, 0.5), (11, 4), (15, 5)


def hashed(y0: int, y1: int, x0: int, x1: int) -> np.ndarray:
    """Three planes of a hash of each place."""
    y, x = np.arange(y0, y1, dtype=np.uint32)[:, None], np.arange(x0, x1, dtype=np.uint32)[None, :]
    by_x, by_y, again = map(np.uint32, MULTIPLIERS)
    with np.errstate(over="ignore"):
        h = x * by_x + y * by_y
        h = (h ^ (h >> np.uint32(13))) * again
    h ^= h >> np.uint32(16)
    return np.stack([LEAST + (h >> np.uint32(5 * c)) % np.uint32(RANGE) for c in range(3)])


def blurred(planes: np.ndarray, reach: int, sigma: float) -> np.ndarray:
    """In whole numbers again, as an image on file would be."""
    k = focus.bell(reach, sigma)
    return np.rint(arrays.filtered(planes.astype(float), k, k))


def band_rows(h: int, w: int, index: int, frames: int, y0: int, y1: int) -> np.ndarray:
    """Rows of a frame of a stack, rows x columns x 3: sharp in band ``index`` of ``frames`` of its columns, out of focus elsewhere."""
    reach = GRAIN[0] + BLUR[0]
    a, b = max(0, y0 - reach), min(h, y1 + reach)
    sharp = blurred(hashed(a, b, 0, w), *GRAIN)
    own = np.arange(w) * frames // w == index
    out = np.where(own, sharp, blurred(sharp, *BLUR))
    return out[:, y0 - a : y1 - a].transpose(1, 2, 0).astype("<u2")


def band_frame(path: str | Path, h: int, w: int, index: int, frames: int, compression: str = "none", tile: int | None = None, meta: dict | None = None) -> str:
    """A frame written to a file, band by band."""

    def segments() -> Iterator[bytes]:
        step = tile or tiff.strip_rows(w)
        for y in range(0, h, step):
            rows = band_rows(h, w, index, frames, y, min(y + step, h))
            for part in cut(rows, tile) if tile else [rows]:
                yield tiff.packed(part.tobytes(), compression)

    with open(path, "wb") as f:
        tiff.write(f, segments(), h, w, compression, meta or {}, tile=tile)
    return str(path)


def cut(rows: np.ndarray, side: int) -> Iterator[np.ndarray]:
    """A row of square tiles, filled up with zeros."""
    for x in range(0, rows.shape[1], side):
        part = rows[:, x : x + side]
        yield np.pad(part, ((0, side - part.shape[0]), (0, side - part.shape[1]), (0, 0)))


def stroke(h: int, w: int, a: tuple[int, int], b: tuple[int, int], thickness: float) -> np.ndarray:
    """Places within half the thickness of the line from a to b (x, y)."""
    y, x = np.mgrid[0:h, 0:w]
    p, d = (x - a[0]) + 1j * (y - a[1]), complex(b[0] - a[0], b[1] - a[1])
    t = np.clip((p * np.conj(d)).real / abs(d) ** 2, 0, 1)
    return np.abs(p - t * d) <= thickness / 2


def spread(mask: np.ndarray, reach: int) -> np.ndarray:
    """Places with a place of the mask in the square around them."""
    return ~arrays.eroded(~mask, reach)


def occlusion(bright: bool = False, seed: int = SCENE_SEED) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """A disc and thin strokes before a textured ground: the truth, a frame that is sharp near and one that is sharp far, places about the outlines, and the thin strokes."""
    h, w = SCENE_SIZE
    ground = blurred(np.random.default_rng(seed).integers(*GROUND[bright], (h, w, 3), dtype=np.uint16).transpose(2, 0, 1), *SOIL)
    y, x = np.mgrid[0:h, 0:w]
    mask = (x - DISC[0]) ** 2 + (y - DISC[1]) ** 2 <= DISC[2] ** 2
    for stroke_of in STROKES:
        mask |= stroke(h, w, *stroke_of)
    colour = np.array(COLOUR[bright], float)[:, None, None]
    truth = np.where(mask, colour, ground)
    near = np.where(mask, colour, blurred(ground, *BEHIND))
    soft = arrays.filtered(mask.astype(float), *[focus.bell(*BEFORE)] * 2)
    far = colour * soft + ground * (1 - soft)
    image = lambda a: np.floor(a).transpose(1, 2, 0).astype(np.uint16)
    edges = spread(mask, 8) & ~(mask & ~spread(~mask, 2))
    return image(truth), [image(near), image(far)], edges, mask & (x > 190)
