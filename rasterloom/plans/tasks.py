"""Work on items of the driver's, one Spark task each: what they share is broadcast, what they find comes back."""

from __future__ import annotations

import pickle
import resource
import sys
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from rasterloom.sources.tiff import Refused

#: Tasks of one job at most; further items share tasks.
MOST_TASKS = 1 << 16


def peak_memory() -> int:
    """The most that this process has had in memory, in bytes."""
    used = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    return used if sys.platform == "darwin" else used * 1024


class Crew:
    """Runs jobs, and keeps the most memory that a worker had."""

    def __init__(self, spark: SparkSession, seen: Callable[[str, int, int], None] | None = None):
        self.spark, self.seen, self.peak = spark, seen or (lambda *_: None), peak_memory()

    @property
    def cores(self) -> int:
        return self.spark.sparkContext.defaultParallelism

    def run(self, stage: str, items: Sequence[Any], work: Callable[[Any], Any], tasks: int | None = None) -> list[Any]:
        """``work(item)`` for each item, in their order.  A ``Refused`` of the first item that has one is raised; a task that is lost is run again."""
        if not items:
            return []
        self.seen(stage, 0, len(items))
        held = self.spark.sparkContext.broadcast(list(items))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in b.column(0).to_pylist():
                    try:
                        found = work(held.value[k])
                    except Refused as e:
                        found = e
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([pickle.dumps(found)], pa.binary()), pa.array([peak_memory()], pa.int64())], names=["id", "found", "peak"])

        n = min(tasks or len(items), len(items), MOST_TASKS)
        try:
            rows = self.spark.range(0, len(items), 1, n).mapInArrow(each, "id long, found binary, peak long").collect()
        except PySparkException as e:
            said = [line for line in str(e).splitlines() if line.strip()]
            raise Refused(f"{stage} failed: {said[-1] if said else type(e).__name__}") from e
        finally:
            held.destroy()
        self.peak = max(self.peak, *(r.peak for r in rows))
        found = [pickle.loads(r.found) for r in sorted(rows)]
        for f in found:
            if isinstance(f, Refused):
                raise f
        self.seen(stage, len(items), len(items))
        return found
