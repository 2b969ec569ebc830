"""Shared pieces: reading tables, the shared scratch folder, sized joins, row locators."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many bytes one side of a join is broadcast; its rows are counted first.
BROADCAST_BYTES = 24 << 20
#: Prefix of the columns that the operators add for themselves.
OWN = "__loom_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as ``spark.checkpoint.dir`` names it.

    Where nothing is named a temporary folder is set, but only in local mode: on
    a cluster no folder of the driver's is seen by the executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loom-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


#: Folders made since each open ``cleared`` began, innermost last.
_MADE: list[list[str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/loom/{name}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it back.

    Survives lost executors, and unlike ``checkpoint()`` it runs the plan once.
    """
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, all intermediate tables that were made within it; what is to last is written within and made before."""
    _MADE.append([])
    try:
        yield
    finally:
        for folder in _MADE.pop():
            _delete(spark, folder)


def discarded(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/loom/" not in folder:
                raise ValueError(f"{folder} is not an intermediate table")
            _delete(df.sparkSession, folder)


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small``, both read from files, where a few keys may hold most rows of ``big``.

    small: a row for each key, and in ``count`` how many rows of ``big`` have it, at least.
    Keys with more rows than an even share of the shuffle's partitions are
    broadcast, and their rows stay where they are; there are fewer such keys
    than partitions, whatever the data.  The others are shuffled.
    """
    parts = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total, most = small.agg(F.sum(count), F.max(count)).first()
    share = max(1, (total or 0) // parts)
    if (most or 0) <= share:
        return big.join(small.hint("merge"), keys, how)
    hot = small.filter(F.col(count) > share)
    rest = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return big.join(F.broadcast(hot), keys).unionByName(rest.join(small.filter(F.col(count) <= share).hint("merge"), keys, how))


def sized(side: DataFrame, row_bytes: int) -> DataFrame:
    """``side`` (already written) with a broadcast hint if its counted rows prove it small."""
    small = side.count() * row_bytes <= BROADCAST_BYTES
    return F.broadcast(side) if small else side


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with a locator of each row: the columns ``__loom_file`` and ``__loom_row``.

    A file-backed frame has the file's path and the row's place in it; a frame that has a locator keeps it.  Any
    other frame is written to the shared folder first, so that the locator
    stays the same however often the rows are read again.
    """
    def place(df: DataFrame) -> DataFrame:
        return df.select("*", F.col("_metadata.file_path").alias(OWN + "file"), F.col("_metadata.row_index").alias(OWN + "row"))

    if OWN + "file" in docs.columns:
        return docs
    with contextlib.suppress(AnalysisException):
        if "_metadata" not in docs.columns:
            return place(docs)
    return place(written(docs, "located"))


def without_own(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(OWN)])


#: Bytes of an Arrow batch of texts, at most: a few of them are in the JVM's and in Python's memory at once.
BATCH = 8 << 20


def light(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on hands over batches of ``BATCH`` bytes at most, unless its own are smaller.

    A batch's rows are bounded by default, but ten thousand long texts are too much for a small executor.
    """
    key, units = "spark.sql.execution.arrow.maxBytesPerBatch", {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    found = re.fullmatch(r"(-?[0-9]+)([kmg]?)b?", df.sparkSession.conf.get(key).lower())
    size = int(found[1]) * units[found[2]] if found else -1
    if not 0 < size <= BATCH:
        df.sparkSession.conf.set(key, f"{BATCH}b")
    return df


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def packed_sum(parts: DataFrame, width: int = 32) -> DataFrame:
    """parts: rows of ``key``, ``task`` (any spread) and ``data``, packed doubles; best without a shuffle in its plan, which would run twice.

    A tree over the partitions that there really are: each level adds up about
    ``width`` of the former level's tasks, so no task reads more than its share
    and at most ``width`` rows of a key are left.
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sums = TaskContext.get().partitionId(), {}
        for b in batches:
            for key, data in zip(b.column(0).to_pylist(), b.column(2)):
                value = np.frombuffer(data.as_buffer(), np.float64)
                sums[key] = sums[key] + value if key in sums else value.copy()
        for key, value in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([task], pa.int32()), pa.array([value.tobytes()], pa.binary())], names=["key", "task", "data"])

    tasks = parts.rdd.getNumPartitions()
    while tasks > width:
        tasks = -(-tasks // width)
        parts = parts.repartition(tasks, "task").mapInArrow(add, "key string, task int, data binary")
    return parts


def summed(parts: DataFrame) -> dict[str, np.ndarray]:
    """The sums of ``packed_sum`` on the driver: as many vectors as there are keys, times a constant."""
    total: dict[str, np.ndarray] = {}
    for row in packed_sum(parts).toLocalIterator():
        value = np.frombuffer(row.data, np.float64)
        total[row.key] = total[row.key] + value if row.key in total else value
    return total
