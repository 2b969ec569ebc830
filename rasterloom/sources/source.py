"""Frames as a Spark data source: ``spark.read.format("rasterloom").load(folder)``.

``form`` ``frames`` (the default) has a row for each file, from its header alone;
``blocks`` has the pixels, in blocks of ``side`` places, read band by band.  Filters
on ``frame`` and on a block's ``y0``, ``y1``, ``x0``, ``x1`` are pushed down: files
and bands that no row of the answer lies in are not read.  ``register`` makes the
source known to a session.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from rasterloom.sources import frames, tiff
from rasterloom.sources.tiff import Refused

FRAMES = "frame int, path string, h int, w int, depth int, orientation int, packed boolean, icc binary"
BLOCKS = "frame int, y0 int, y1 int, x0 int, x1 int, data binary"
SIDE = 512
#: What a pushed filter keeps of a column's numbers.
KEEPS = {
    EqualTo: lambda v, x: x == v, In: lambda v, x: x in v, GreaterThan: lambda v, x: x > v, GreaterThanOrEqual: lambda v, x: x >= v, LessThan: lambda v, x: x < v, LessThanOrEqual: lambda v, x: x <= v,
}


@dataclass
class Band(InputPartition):
    """Some files, or one file's blocks of one row of blocks."""

    numbers: Sequence[int]
    y0: int = 0
    y1: int = 0


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rasterloom"

    @property
    def form(self) -> str:
        form = self.options.get("form", "frames")
        if form not in ("frames", "blocks"):
            raise Refused(f"form {form!r}: frames or blocks")
        return form

    def schema(self) -> str:
        return FRAMES if self.form == "frames" else BLOCKS

    def reader(self, schema) -> DataSourceReader:
        return RasterReader(self.form, frames.discovered([self.options["path"]]), int(self.options.get("side", SIDE)))


class RasterReader(DataSourceReader):
    def __init__(self, form: str, paths: list[str], side: int):
        self.form, self.paths, self.side = form, paths, side
        self.kept: list[tuple[type, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters are used to leave out files and bands; Spark still applies them to the rows."""
        for f in filters:
            if type(f) in KEEPS and len(f.attribute) == 1:
                self.kept.append((type(f), f.attribute[0], f.value))
            yield f

    def fits(self, **numbers: int) -> bool:
        """Whether a row with these numbers can pass; columns that are not given can be anything."""
        return all(KEEPS[kind](value, numbers[column]) for kind, column, value in self.kept if column in numbers)

    def partitions(self) -> Sequence[Band]:
        numbers = [k for k in range(len(self.paths)) if self.fits(frame=k)]
        if self.form == "frames":
            return [Band(numbers[k : k + 16]) for k in range(0, len(numbers), 16)] or [Band([])]
        out = []
        for k in numbers:
            h = tiff.header(self.paths[k]).shown[0]
            out += [Band([k], y, min(y + self.side, h)) for y in range(0, h, self.side) if self.fits(y0=y, y1=min(y + self.side, h))]
        return out or [Band([])]

    def read(self, partition: Band) -> Iterator[pa.RecordBatch]:
        for k in partition.numbers:
            head = tiff.header(self.paths[k])
            h, w = head.shown
            if self.form == "frames":
                row = {"frame": k, "path": self.paths[k], "h": h, "w": w, "depth": head.depth, "orientation": head.orientation, "packed": not head.plain, "icc": head.meta.get("icc")}
                kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds)], names=list(row))
                continue
            for x in range(0, w, self.side):
                x1 = min(x + self.side, w)
                if self.fits(x0=x, x1=x1):
                    data = tiff.window(head, partition.y0, partition.y1, x, x1).astype("<u2", copy=False).tobytes()
                    row = {"frame": k, "y0": partition.y0, "y1": partition.y1, "x0": x, "x1": x1}
                    yield pa.RecordBatch.from_arrays([*[pa.array([v], pa.int32()) for v in row.values()], pa.array([data], pa.binary())], names=[*row, "data"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)
