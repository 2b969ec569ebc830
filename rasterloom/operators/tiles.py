"""Tiles: cores, their halos, exchange of blocks, region reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, h: int, w: int, size: int, halo: int, align: int = 1) -> DataFrame:
    """tile, core y0, y1, x0, x1 and the expanded window, clamped and widened outwards to multiples of ``align``."""
    ny, nx = -(-h // size), -(-w // size)
    t = spark.range(ny * nx).select(F.col("id").cast("int").alias("tile"), F.expr(f"cast(id div {nx} as int) * {size}").alias("y0"), F.expr(f"cast(id % {nx} as int) * {size}").alias("x0"))
    t = t.withColumn("y1", F.least(F.col("y0") + size, F.lit(h))).withColumn("x1", F.least(F.col("x0") + size, F.lit(w)))
    low = lambda c: F.expr(f"greatest({c} - {halo}, 0) div {align} * {align}").cast("int")
    high = lambda c, n: F.expr(f"least(({c} + {halo} + {align - 1}) div {align} * {align}, {n})").cast("int")
    return t.select("tile", "y0", "y1", "x0", "x1", low("y0").alias("hy0"), high("y1", h).alias("hy1"), low("x0").alias("hx0"), high("x1", w).alias("hx1"))


def blocks_of(windows: DataFrame, block: int, y0: str = "hy0", y1: str = "hy1", x0: str = "hx0", x1: str = "hx1") -> DataFrame:
    """A row for each block that a window touches (by, bx): a range join turned into an equi-join."""
    span = lambda a, b: F.explode(F.expr(f"sequence({a} div {block}, ({b} - 1) div {block})"))
    return windows.filter(f"{y1} > {y0} and {x1} > {x0}").withColumn("by", span(y0, y1)).withColumn("bx", span(x0, x1)).withColumns({"by": F.col("by").cast("int"), "bx": F.col("bx").cast("int")})


def exchanged(pixels: DataFrame, tiles: DataFrame, block: int) -> DataFrame:
    """Every pixel with each tile whose window it lies in; ``core`` tells whether it is the tile's own.

    The tile table is a few numbers a tile and is only broadcast if its size, which Spark knows, allows it.
    """
    own = pixels.withColumns({"by": F.expr(f"cast(y div {block} as int)"), "bx": F.expr(f"cast(x div {block} as int)")})
    rows = own.join(blocks_of(tiles, block), ["by", "bx"]).filter("y >= hy0 and y < hy1 and x >= hx0 and x < hx1")
    return rows.withColumn("core", F.expr("y >= y0 and y < y1 and x >= x0 and x < x1"))


def cropped(rows: DataFrame) -> DataFrame:
    return rows.filter("core")
