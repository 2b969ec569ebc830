"""Neighbourhood operators on rasters of any size: blocks with a halo, one exchange, NumPy kernels.

A raster is cut into blocks; every pixel goes to its own block and to those whose
halo it lies in, which is the only shuffle, whatever the kernel chains together.
A task takes its blocks one after another, as arrays: blocks of one shape are
stacked, so that many small rasters are worked on at once.  Rasters are dense:
each of their places has a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Side of a block, and places that are worked on at once.
SIDE, AT_ONCE = 512, 1 << 21
KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


@dataclass(frozen=True)
class Block:
    """planes: by name, rasters (or frames of one raster) x rows x columns; box: y0, y1, x0, x1 of all of them."""

    planes: dict[str, np.ndarray]
    box: tuple[int, int, int, int]
    frames: np.ndarray | None = None

    def __getitem__(self, name: str) -> np.ndarray:
        return self.planes[name]


#: Planes by name, or several levels of them, each half as large as the former.
Kernel = Callable[[Block], dict[str, np.ndarray] | list[dict[str, np.ndarray]]]


def dealt(df: DataFrame, h: int, w: int, halo: int, side: int) -> DataFrame:
    """Each pixel with the blocks that need it: ``by``, ``bx``."""
    def needed(c: str, n: int):
        if n <= side:
            return F.lit(0)
        return F.explode(F.expr(f"sequence(cast(greatest({c} - {halo}, 0) div {side} as int), cast(least({c} + {halo}, {n - 1}) div {side} as int))"))

    return df.withColumn("by", needed("y", h)).withColumn("bx", needed("x", w))


def by_block(
    df: DataFrame, keys: list[str], values: list[str], h: int, w: int, halo: int, kernel: Kernel, columns: dict[str, str],
    side: int = SIDE, grid: int = 1, frame: str | None = None, levels: bool = False,
) -> DataFrame:
    """``kernel`` on each raster (named by ``keys``), block by block: ``keys``, ``y``, ``x`` and the kernel's ``columns``.

    halo: how far the kernel looks; grid: blocks and halos are multiples of it; frame: a raster's frames, which the kernel
    then sees together and makes one plane of, or some, each with its number; levels: the kernel gives several levels, and
    a column ``level`` tells them apart.
    """
    halo, side = -(-halo // grid) * grid, -(-side // grid) * grid
    inner = [frame] if frame else []
    rows = dealt(df.select(*keys, *inner, "y", "x", *values), h, w, halo, side).select(*keys, "by", "bx", *inner, "y", "x", *values)
    order = [*keys, "by", "bx", *inner, "y", "x"]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ddl = [*[f"{k} {types[k]}" for k in keys], *(["level int"] if levels else []), "y int", "x int", *[f"{c} {t}" for c, t in columns.items()]]
    sorted_rows = rows.repartition(*keys, "by", "bx").sortWithinPartitions(*order)

    def window(by: int, bx: int) -> tuple[int, int, int, int]:
        return max(0, by * side - halo), min(h, (by + 1) * side + halo), max(0, bx * side - halo), min(w, (bx + 1) * side + halo)

    def out_of(part: pa.Table, starts: np.ndarray, by: int, bx: int, size: int) -> Iterator[pa.RecordBatch]:
        """Groups of one shape, from row ``starts`` on, of ``size`` rows each."""
        y0, y1, x0, x1 = box = window(by, bx)
        shape = (y1 - y0, x1 - x0)
        places = shape[0] * shape[1]
        if size % places or (size != places and not frame):
            raise ValueError(f"block {by}, {bx} has {size} rows for {places} places: the raster is not dense")
        first = int(starts[0])
        taken = part.slice(first, size * len(starts))
        planes = {v: taken.column(v).to_numpy().reshape(-1, *shape) for v in values}
        numbers = taken.column(frame).to_numpy()[::places] if frame else None
        made = kernel(Block(planes, box, numbers))
        for level, found in enumerate(made if levels else [made]):
            step = 1 << level
            a, b, c, d = by * side, min(h, (by + 1) * side), bx * side, min(w, (bx + 1) * side)
            ys, xs = np.arange(-(-a // step), -(-b // step), dtype=np.int32), np.arange(-(-c // step), -(-d // step), dtype=np.int32)
            at = (..., slice(ys[0] - y0 // step, ys[-1] + 1 - y0 // step), slice(xs[0] - x0 // step, xs[-1] + 1 - x0 // step))
            n, each = max(len(a) for a in found.values()), len(ys) * len(xs)
            owner = np.repeat(starts, n // len(starts) * each) if n else starts[:0]
            own = [part.column(k).take(pa.array(owner)).combine_chunks() for k in keys]
            own += [pa.array(np.full(n * each, level, np.int32))] if levels else []
            own += [pa.array(np.tile(np.repeat(ys, len(xs)), n)), pa.array(np.tile(xs, n * len(ys)))]
            for name, kind in columns.items():  # planes, or a number for each
                plane = found[name][at] if found[name].ndim == 3 else np.repeat(found[name], each)
                own.append(pa.array(np.ascontiguousarray(plane).reshape(-1)).cast(KINDS[kind]))
            yield pa.RecordBatch.from_arrays(own, names=[*keys, *(["level"] if levels else []), "y", "x", *columns])

    def settled(part: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(np.append(starts, part.num_rows))
        by, bx = part.column("by").to_numpy()[starts], part.column("bx").to_numpy()[starts]
        at = 0
        while at < len(starts):
            most = 1 if frame else max(1, AT_ONCE // int(sizes[at]))
            same = (by[at : at + most] == by[at]) & (bx[at : at + most] == bx[at]) & (sizes[at : at + most] == sizes[at])
            n = int(same.argmin()) if not same.all() else len(same)
            yield from out_of(part, starts[at : at + n], int(by[at]), int(bx[at]), int(sizes[at]))
            at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        waiting = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            waiting += b.num_rows
            if waiting < AT_ONCE // 4:
                continue
            part = pa.Table.from_batches(held).combine_chunks()
            starts = _starts(part, [*keys, "by", "bx"])
            if len(starts) > 1:  # the last group may go on
                last = int(starts[-1])
                yield from settled(part.slice(0, last), starts[:-1])
                part = part.slice(last).combine_chunks()
            held, waiting = part.to_batches(), 0
        if held:
            part = pa.Table.from_batches(held).combine_chunks()
            yield from settled(part, _starts(part, [*keys, "by", "bx"]))

    return sorted_rows.mapInArrow(run, ", ".join(ddl))


def _starts(part: pa.Table, keys: list[str]) -> np.ndarray:
    """Where groups of equal keys begin."""
    new = np.zeros(part.num_rows, bool)
    new[0] = True
    for k in keys:
        c = part.column(k)
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy()
    return np.flatnonzero(new)
