"""Planes of pixels in plain files of a shared folder: tasks write and read windows of them."""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Plane:
    """h x w places of ``channels`` values of type ``kind``, row by row from byte ``start`` on."""

    path: str
    h: int
    w: int
    kind: str
    channels: int = 1
    start: int = 0

    @property
    def place(self) -> int:
        return np.dtype(self.kind).itemsize * self.channels

    @property
    def nbytes(self) -> int:
        return self.h * self.w * self.place

    def made(self) -> Plane:
        """Room for all of it."""
        with open(self.path, "ab") as f:
            f.truncate(self.start + self.nbytes)
        return self

    def write(self, y: int, x: int, values: np.ndarray) -> None:
        """Values (rows x columns, or x channels) from place y, x on.  Writing the same again does no harm."""
        rows = np.ascontiguousarray(values, self.kind).reshape(values.shape[0], -1)
        whole = values.shape[1] == self.w
        f = os.open(self.path, os.O_WRONLY)
        try:
            for k, part in [(0, rows)] if whole else enumerate(rows):
                data, at = memoryview(np.ascontiguousarray(part)).cast("B"), self.start + ((y + k) * self.w + x) * self.place
                while len(data):
                    n = os.pwrite(f, data, at)
                    data, at = data[n:], at + n
        finally:
            os.close(f)

    def read(self, y0: int, y1: int, x0: int, x1: int) -> np.ndarray:
        """A window; rows x columns x channels, or rows x columns of a single channel."""
        out = np.empty((y1 - y0, (x1 - x0) * self.channels), self.kind)
        with open(self.path, "rb", buffering=0) as f:
            whole = (x0, x1) == (0, self.w)
            for k, part in [(0, out)] if whole else enumerate(out):
                f.seek(self.start + ((y0 + k) * self.w + x0) * self.place)
                into = memoryview(part).cast("B")
                while len(into):
                    n = f.readinto(into)
                    if not n:
                        raise OSError(f"{self.path} is cut")
                    into = into[n:]
        return out.reshape(y1 - y0, x1 - x0, self.channels) if self.channels > 1 else out


def copied(source: str, at: int, count: int, target: str, to: int) -> None:
    """``count`` bytes of one file to a place in another."""
    with open(source, "rb", buffering=0) as f:
        out = os.open(target, os.O_WRONLY)
        try:
            f.seek(at)
            while count:
                data = f.read(min(count, 1 << 22))
                if not data:
                    raise OSError(f"{source} is cut")
                done = 0
                while done < len(data):
                    done += os.pwrite(out, data[done:], to + done)
                to, count = to + len(data), count - len(data)
        finally:
            os.close(out)
