"""The two passes over a window: which frame each place is taken from, and the frames' layers put together.

The first pass needs only the reach of the focus measure around a place, the
second that of the whole pyramid; they run on windows of their own, and what the
first one decides is kept in two planes, the label and how sure it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np

from rasterloom.operators import arrays

Box = tuple[int, int, int, int]
#: Reads a frame's window as three planes of floats, carried to the reference, and which places it covers.
Read = Callable[[int, Box], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Rules:
    """levels: pyramid steps, 0 for plain weighted means; support: how far a place's focus score looks."""

    levels: int
    support: int
    focus_radius: int
    blend_radius: int
    coarse: bool = False  # a further scale of the plain score
    best: bool = False  # all scales of the photographic score

    def score(self, grey: np.ndarray) -> np.ndarray:
        if self.levels:
            return arrays.photographic_score(grey, self.focus_radius, self.best)
        return arrays.standard_score(grey, self.focus_radius, self.coarse)


def chosen(read: Read, frames: Iterable[int], box: Box, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """The label of each place, 16 bits, and how sure it is: near 1 the label's own pixels are kept as they are."""
    best = None
    for k in frames:
        rgb, valid = read(k, box)
        grey = arrays.grey(rgb)
        best = best or arrays.Best(grey.shape, grey.dtype)
        usable, score = arrays.eroded(valid, rules.support), rules.score(grey)
        best.see(score if usable.all() else np.where(usable, score, score.dtype.type(-1)), k, grey)
    confidence = best.confidence()
    if not rules.levels:
        return arrays.cleaned(best, confidence, None), np.clip(4 * confidence, 0, 1)
    edge = best.edge()
    return arrays.cleaned(best, confidence, edge), np.maximum(np.clip(5 * confidence, 0, 1), edge)


class Layers:
    """Sums over the frames of a window, by level of the pyramid; as many planes as there are levels, however many frames."""

    def __init__(self, label: np.ndarray, sure: np.ndarray, rules: Rules):
        self.label, self.sure, self.rules = label, sure, rules
        sizes = [label.shape]
        for _ in range(rules.levels):
            sizes.append(tuple((s + 1) // 2 for s in sizes[-1]))
        self.sums, self.totals = [np.zeros((3, *s), sure.dtype) for s in sizes], [np.zeros(s, sure.dtype) for s in sizes]
        self.own = np.zeros((3, *label.shape), sure.dtype) if rules.levels else None

    def weight(self, mask: np.ndarray) -> np.ndarray:
        """Soft about the mask's border, hard where the choice is sure."""
        soft = arrays.smooth(mask, self.rules.blend_radius)
        hard = self.sure if not self.rules.levels else 1 - (1 - self.sure) * np.clip(4 * soft * (1 - soft), 0, 1)
        return soft + hard * (mask - soft)

    def add(self, frame: int, rgb: np.ndarray, valid: np.ndarray) -> None:
        mask = (self.label == frame).astype(self.sure.dtype)
        weight, held = self.weight(mask), mask
        if not valid.all():
            weight, held = weight * valid, mask * valid
        for level, band in enumerate(arrays.pyramid(rgb, self.rules.levels)):
            here = weight
            if level:
                weight, step = arrays.down(weight), 1 << level
                sure = self.sure[::step, ::step]
                here = weight + sure * (held[::step, ::step] - weight)
            band *= here
            self.sums[level] += band
            self.totals[level] += here
        if self.own is not None:
            self.own += rgb * held

    def image(self, fallback: Callable[[], np.ndarray]) -> np.ndarray:
        """Rows x columns x 3 of 16 bits; where no frame has weight, the fallback's pixels, which are only read then."""
        out = arrays.collapsed([s / np.maximum(t, t.dtype.type(arrays.FLOOR)) for s, t in zip(self.sums, self.totals)])
        if self.own is not None:
            out += self.sure * (self.own - out)
        bare = self.totals[0] <= arrays.FLOOR
        if bare.any():
            out = np.where(bare, fallback(), out)
        return np.ascontiguousarray(arrays.to_u16(out).transpose(1, 2, 0))


def merged(read: Read, label: np.ndarray, sure: np.ndarray, box: Box, rules: Rules, reference: int) -> np.ndarray:
    """One window of the result: only frames that some place is labelled with are read."""
    layers = Layers(label, sure, rules)
    for k in np.unique(label).tolist():
        layers.add(k, *read(k, box))
    return layers.image(lambda: read(reference, box)[0])


def both(read: Read, n: int, box: Box, rules: Rules, reference: int) -> np.ndarray:
    """The two passes on one window."""
    return merged(read, *chosen(read, range(n), box, rules), box, rules, reference)
