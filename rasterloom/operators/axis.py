"""Linear neighbourhood operators as weighted maps along each axis.

A filter along one axis, with its border rule, is a small table (src, out, w):
place ``src`` adds ``w`` times its value to place ``out``.  Smoothing,
derivatives, pyramid steps, area binning and resizing are all such tables, built
on the driver.  On pixels a table is a broadcast join on the place and a sum by
output place: one shuffle, with partial sums before it, and no join of the
raster with itself.  That form defines what the operators do; rasters of any size
go through ``blocks``, whose kernels (``arrays``) apply the same tables as banded
matrices.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.pixel import reflect101, replicate

#: Rows of an axis table that are still broadcast.
MOST = 1_000_000


def mirrored(places: np.ndarray, n: int) -> np.ndarray:
    """Mirrored about the first and last place, which are not repeated; over any number of mirrors."""
    if n == 1:
        return np.zeros_like(places)
    m = places % (2 * (n - 1))
    return np.minimum(m, 2 * (n - 1) - m)


def entries(src: np.ndarray, out: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The table of these triples, with those of the same places added up, by out: columns src, out, w."""
    wide = int(src.max()) + 1
    pairs, at = np.unique(out * wide + src, return_inverse=True)
    return np.column_stack([pairs % wide, pairs // wide, np.bincount(at, w)])


def around(n: int, weights: dict[int, float], odd: bool = False) -> np.ndarray:
    """out = the sum of weight times the value at out + offset, borders mirrored; ``odd``: values change their sign in a mirror, as a derivative does."""
    d = np.array(list(weights), np.int64)
    out = np.repeat(np.arange(n), len(d))
    at, w = out + np.tile(d, n), np.tile(np.array(list(weights.values()), float), n)
    if odd:
        turned = at % (2 * (n - 1)) if n > 1 else at * 0
        w = np.where(turned > n - 1, -w, np.where(turned % max(n - 1, 1) == 0, 0.0, w))
    return entries(mirrored(at, n), out, w)


def framed(spark: SparkSession, table: np.ndarray) -> DataFrame:
    """A table as a frame of the driver's."""
    return _small(spark.createDataFrame([(int(s), int(o), float(w)) for s, o, w in table], "src int, out int, w double"), len(table))


def taps(spark: SparkSession, n: int, weights: dict[int, float]) -> DataFrame:
    return framed(spark, around(n, weights))


def gaussian(radius: int) -> dict[int, float]:
    """2 radius + 1 taps, sigma a third of the radius but 0.5 at least; radius 0 changes nothing."""
    sigma = max(radius / 3, 0.5)
    raw = {d: math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-radius, radius + 1)}
    total = sum(raw.values())
    return {d: w / total for d, w in raw.items()} if radius else {0: 1.0}


IDENTITY = {0: 1.0}
RISE, BELL = {-1: -1.0, 1: 1.0}, {-1: 1.0, 0: 2.0, 1: 1.0}
SECOND = {-1: 1.0, 0: -2.0, 1: 1.0}
STEP = {0: 1.0, 1: -1.0}
#: The pyramid's kernel (fixed values).
BINOMIAL = {-2: 1 / 16, -1: 4 / 16, 0: 6 / 16, 1: 4 / 16, 2: 1 / 16}


def halving(n: int) -> np.ndarray:
    """One pyramid step down: (n + 1) // 2 places."""
    t = around(n, BINOMIAL)
    t = t[t[:, 1] % 2 == 0]
    return np.column_stack([t[:, 0], t[:, 1] // 2, t[:, 2]])


def doubling(n: int) -> np.ndarray:
    """One pyramid step up, to n places: values on even places, twice the kernel."""
    t = around(n, BINOMIAL)
    t = t[t[:, 0] % 2 == 0]
    return np.column_stack([t[:, 0] // 2, t[:, 1], t[:, 2] * (2 if n > 1 else 1)])


def halved(spark: SparkSession, n: int) -> DataFrame:
    return framed(spark, halving(n))


def doubled(spark: SparkSession, n: int) -> DataFrame:
    return framed(spark, doubling(n))


def binned(spark: SparkSession, n: int, m: int) -> DataFrame:
    """Place i falls in bin i * m // n, with weight 1."""
    return _small(_bins(spark, n, m), n)


def _bins(spark: SparkSession, n: int, m: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("src"), F.expr(f"cast(id * {m} div {n} as int)").alias("out"), F.lit(1.0).alias("w"))


def resized(spark: SparkSession, n: int, m: int) -> DataFrame:
    """Area averages: each of m output places weighs the n input places by their overlap."""
    k = spark.range(n).select(F.col("id").cast("int").alias("src"), F.explode(F.expr(f"sequence(id * {m} div {n}, ((id + 1) * {m} - 1) div {n})")).alias("o"))
    overlap = F.expr(f"(least((src + 1) * {m}, (o + 1) * {n}) - greatest(src * {m}, o * {n})) / {n}")
    return _small(k.select("src", F.col("o").cast("int").alias("out"), overlap.cast("double").alias("w")).filter("w > 0"), n + m)


def _small(axis: DataFrame, rows: int) -> DataFrame:
    """A table of so many rows, broadcast if they are few."""
    return F.broadcast(axis) if rows <= MOST else axis


def along(df: DataFrame, axis: DataFrame, place: str, keys: list[str], values: dict[str, Column], n: int) -> DataFrame:
    """Apply an axis table to the places in column ``place``; the other coordinates are ``keys``."""
    rows = df.join(axis, F.col(place) == F.col("src"))
    return rows.groupBy(*keys, F.col("out").alias(place)).agg(*[F.sum(v * F.col("w")).alias(k) for k, v in values.items()])


def filtered(df: DataFrame, keys: list[str], value: Column, name: str, h: int, w: int, vertical: dict[int, float], horizontal: dict[int, float]) -> DataFrame:
    """A separable filter: keys, y, x and ``name``."""
    spark = df.sparkSession
    rows = df.select(*keys, "y", "x", value.cast("double").alias(name))
    if horizontal != IDENTITY:
        rows = along(rows, taps(spark, w, horizontal), "x", [*keys, "y"], {name: F.col(name)}, w)
    if vertical != IDENTITY:
        rows = along(rows, taps(spark, h, vertical), "y", [*keys, "x"], {name: F.col(name)}, h)
    return rows.select(*keys, "y", "x", name)


def several(df: DataFrame, keys: list[str], value: Column, h: int, w: int, kernels: dict[str, dict[tuple[int, int], float]], border=reflect101) -> DataFrame:
    """Several small two-dimensional kernels ((dy, dx): weight) of one plane, in a single shuffle."""
    spark = df.sparkSession
    offsets = sorted({o for k in kernels.values() for o in k})
    table = spark.createDataFrame([(dy, dx, *[float(k.get((dy, dx), 0)) for k in kernels.values()]) for dy, dx in offsets], "dy int, dx int, " + ", ".join(f"k_{n} double" for n in kernels))
    place = lambda n, d: spark.range(n).select(F.col("id").cast("int").alias("o" + d), F.explode(F.array(*[F.lit(v) for v in sorted({o["yx".index(d)] for o in offsets})])).alias("d" + d)).withColumn("s" + d, border(F.col("o" + d) + F.col("d" + d), n).cast("int"))
    rows = df.select(*keys, "y", "x", value.cast("double").alias("v"))
    rows = rows.join(_small(place(h, "y"), h * len(offsets)), F.col("y") == F.col("sy")).join(_small(place(w, "x"), w * len(offsets)), F.col("x") == F.col("sx")).join(F.broadcast(table), ["dy", "dx"])
    return rows.groupBy(*keys, F.col("oy").alias("y"), F.col("ox").alias("x")).agg(*[F.sum(F.col("v") * F.col(f"k_{n}")).alias(n) for n in kernels])


def outer(vertical: dict[int, float], horizontal: dict[int, float]) -> dict[tuple[int, int], float]:
    return {(dy, dx): a * b for dy, a in vertical.items() for dx, b in horizontal.items()}


def neighbours(df: DataFrame, keys: list[str], value: Column, h: int, w: int, radius: int, agg, border=replicate) -> DataFrame:
    """Any aggregate over the square neighbourhood of each pixel: ``agg`` of the column ``v``."""
    spark = df.sparkSession
    steps = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    rows = df.select(*keys, "y", "x", value.alias("v"))
    for place, n in (("y", h), ("x", w)):
        table = spark.range(n).select(F.col("id").cast("int").alias("out"), steps.alias("d")).select(border(F.col("out") + F.col("d"), n).cast("int").alias("src"), "out")
        rows = rows.join(_small(table, n * (2 * radius + 1)), F.col(place) == F.col("src")).drop("src", place).withColumnRenamed("out", place)
    return rows.groupBy(*keys, "y", "x").agg(agg(F.col("v")).alias("v"))
