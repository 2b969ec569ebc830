"""Rasters made of tables, and synthetic ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.pixel import texture
from rasterloom.operators import blocks
from rasterloom.sources import scenes

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector a frame of 8 x 8 grey values, 16 bits; its label is the stack."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("stack"), F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("pos", "e"))
    v = F.least(F.greatest(F.floor((F.col("e").cast("double") + 1) * 32767), F.lit(0)), F.lit(65535)).cast("int")
    return rows.select("stack", "frame", F.expr(f"pos div {SIDE}").cast("int").alias("y"), (F.col("pos") % SIDE).alias("x"), v.alias("v"))


def coloured(grey: DataFrame) -> DataFrame:
    """Three channels that follow from the grey value."""
    return grey.select("stack", "frame", "y", "x", F.col("v").alias("r"), ((F.col("v") * 3 + 1000) % 65536).alias("g"), (65535 - F.col("v")).alias("b"))


def focus_bands(spark: SparkSession, frames: int, h: int, w: int) -> DataFrame:
    """A hashed texture, sharp in one band of columns in each frame and out of focus elsewhere."""
    n = spark.range(frames * h * w)
    p = n.select(F.expr(f"cast(id div {h * w} as int)").alias("frame"), F.expr(f"cast(id div {w} % {h} as int)").alias("y"), F.expr(f"cast(id % {w} as int)").alias("x"))
    p = p.select("frame", "y", "x", *[texture(F.col("x"), F.col("y"), c).cast("int").alias("rgb"[c]) for c in range(3)])

    def kernel(b: blocks.Block) -> dict[str, np.ndarray]:
        return {c + kind: a for c in "rgb" for sharp in [scenes.blurred(b[c], *scenes.GRAIN)] for kind, a in (("0", sharp), ("1", scenes.blurred(sharp, *scenes.BLUR)))}

    rows = blocks.by_block(p, ["frame"], list("rgb"), h, w, scenes.GRAIN[0] + scenes.BLUR[0], kernel, {c + k: "int" for c in "rgb" for k in "01"})
    own = F.expr(f"x * {frames} div {w} = frame")
    return rows.select("frame", "y", "x", *[F.when(own, F.col(c + "0")).otherwise(F.col(c + "1")).alias(c) for c in "rgb"])
