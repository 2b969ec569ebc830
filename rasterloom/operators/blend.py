"""Weights, merging and pyramids, pixel by pixel; ``valid`` (0 or 1) tells which pixels of a moved frame there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.pixel import to_u16
from rasterloom.operators import axis, focus
from rasterloom.sources.scratch import held

FLOOR = 1e-8


def clip01(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def masks(frames: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """For every frame that some pixel of its stack is labelled with: its pixels and ``mask``, 1 where it is the label; all are valid unless ``frames`` says so."""
    used = labels.select(*keys, F.col("label").alias("frame")).distinct()
    rows = frames.join(used, [*keys, "frame"], "left_semi").join(labels, [*keys, "y", "x"])
    rows = rows if "valid" in frames.columns else rows.withColumn("valid", F.lit(1))
    return rows.withColumn("mask", (F.col("label") == F.col("frame")).cast("double"))


def softened(rows: DataFrame, keys: list[str], h: int, w: int, radius: int) -> DataFrame:
    soft = focus.smooth(rows, [*keys, "frame"], F.col("mask"), "soft", h, w, radius)
    return rows.join(soft, [*keys, "frame", "y", "x"])


def plain_weight() -> Column:
    """Hard where the choice is sure, soft elsewhere."""
    hard = clip01(4 * F.col("confidence"))
    return (hard * F.col("mask") + (1 - hard) * F.col("soft")) * F.col("valid")


def protection() -> Column:
    return F.greatest(clip01(5 * F.col("confidence")), F.col("edge"))


def occlusion_weight() -> Column:
    """Soft only in unprotected transitions."""
    s = (1 - protection()) * clip01(4 * F.col("soft") * (1 - F.col("soft")))
    return (F.col("mask") * (1 - s) + F.col("soft") * s) * F.col("valid")


def fused(rows: DataFrame, keys: list[str], values: list[str], fallback: DataFrame) -> DataFrame:
    """Weighted means by pixel; where no weight is left, the fallback frame's own value, which is only looked up there."""
    place = [*keys, "y", "x"]
    sums = rows.groupBy(*place).agg(F.sum("weight").alias("total"), *[F.sum(F.col("weight") * F.col(v)).alias(v) for v in values]).filter(F.col("total") > FLOOR)
    means = sums.select(*place, *[to_u16(F.col(v) / F.greatest("total", F.lit(FLOOR))).alias(v) for v in values], F.lit(True).alias("covered"))
    bare = fallback.select(*place, *values).join(sums.select(*place), place, "left_anti")
    return means.unionByName(bare.select(*place, *[to_u16(F.col(v).cast("double")).alias(v) for v in values], F.lit(False).alias("covered")))


def owned(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The values of the frame that each pixel is labelled with."""
    return rows.groupBy(*keys, "y", "x").agg(*[F.sum(F.col(v) * F.col("mask") * F.col("valid")).alias(v) for v in values])


def down(df: DataFrame, keys: list[str], value: str, h: int, w: int) -> DataFrame:
    spark = df.sparkSession
    rows = axis.along(df, axis.halved(spark, w), "x", [*keys, "y"], {value: F.col(value)}, w)
    return axis.along(rows, axis.halved(spark, h), "y", [*keys, "x"], {value: F.col(value)}, h).select(*keys, "y", "x", value)


def up(df: DataFrame, keys: list[str], value: str, h: int, w: int) -> DataFrame:
    """To h x w."""
    spark = df.sparkSession
    rows = axis.along(df, axis.doubled(spark, w), "x", [*keys, "y"], {value: F.col(value)}, w)
    return axis.along(rows, axis.doubled(spark, h), "y", [*keys, "x"], {value: F.col(value)}, h).select(*keys, "y", "x", value)


def pyramid(df: DataFrame, keys: list[str], value: str, h: int, w: int, levels: int) -> DataFrame:
    """Laplacian levels in one frame: ``level``, the last one the smallest image itself."""
    out, now = None, df.select(*keys, "y", "x", F.col(value).cast("double").alias(value))
    for level in range(levels):
        small = held(down(now, keys, value, h, w), "pyramid")
        back = up(small, keys, value, h, w).withColumnRenamed(value, "back")
        lap = now.join(back, [*keys, "y", "x"]).select(*keys, F.lit(level).alias("level"), "y", "x", (F.col(value) - F.col("back")).alias(value))
        out = lap if out is None else out.unionByName(lap)
        now, h, w = small, (h + 1) // 2, (w + 1) // 2
    last = now.select(*keys, F.lit(levels).alias("level"), "y", "x", value)
    return last if out is None else out.unionByName(last)


def collapsed(levels: DataFrame, keys: list[str], value: str, h: int, w: int, n: int) -> DataFrame:
    """The image of a Laplacian pyramid of n steps."""
    sizes = [(h, w)]
    for _ in range(n):
        sizes.append(((sizes[-1][0] + 1) // 2, (sizes[-1][1] + 1) // 2))
    now = levels.filter(F.col("level") == n).select(*keys, "y", "x", value)
    for k in range(n - 1, -1, -1):
        back = up(now, keys, value, *sizes[k]).withColumnRenamed(value, "back")
        now = levels.filter(F.col("level") == k).join(back, [*keys, "y", "x"]).select(*keys, "y", "x", (F.col(value) + F.col("back")).alias(value))
    return now


def multiband(rows: DataFrame, keys: list[str], value: str, h: int, w: int, levels: int) -> DataFrame:
    """rows: frames with ``weight``, ``mask``, ``confidence`` and ``edge``.  Blended by level, then collapsed: ``value`` and ``coverage``.

    The weights of coarser levels are those of the level below, smoothed and
    halved, and hard where the choice, sampled every 2**level places, is protected.
    """
    own = [*keys, "frame"]
    rows = held(rows, "weights")
    bands = pyramid(rows, own, value, h, w, levels)
    p = protection()
    weights, size = rows.select(*own, F.lit(0).alias("level"), "y", "x", "weight"), (h, w)
    now = rows.select(*own, "y", "x", "weight")
    for k in range(1, levels + 1):
        now, size = held(down(now, own, "weight", *size), "weights"), ((size[0] + 1) // 2, (size[1] + 1) // 2)
        step = 1 << k
        at = rows.filter(f"y % {step} = 0 and x % {step} = 0").select(*own, F.expr(f"cast(y div {step} as int)").alias("y"), F.expr(f"cast(x div {step} as int)").alias("x"), p.alias("p"), (F.col("mask") * F.col("valid")).alias("mask"))
        weight = F.col("weight") * (1 - F.col("p")) + F.col("mask") * F.col("p")
        weights = weights.unionByName(now.join(at, [*own, "y", "x"]).select(*own, F.lit(k).alias("level"), "y", "x", weight.alias("weight")))
    sums = bands.join(weights, [*own, "level", "y", "x"]).groupBy(*keys, "level", "y", "x").agg(F.sum("weight").alias("wsum"), F.sum(F.col("weight") * F.col(value)).alias("wvsum"))
    sums = held(sums, "bands")
    means = sums.select(*keys, "level", "y", "x", (F.col("wvsum") / F.greatest("wsum", F.lit(FLOOR))).alias(value))
    image = collapsed(means, keys, value, h, w, levels)
    return image.join(sums.filter("level = 0").select(*keys, "y", "x", (F.col("wsum") > FLOOR).alias("covered")), [*keys, "y", "x"])


def protected(image: DataFrame, own: DataFrame, guard: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The blended image, drawn to the owned values where the choice is protected."""
    rows = image.join(own.withColumnRenamed(value, "own"), [*keys, "y", "x"]).join(guard, [*keys, "y", "x"])
    return rows.select(*keys, "y", "x", (F.col(value) * (1 - protection()) + F.col("own") * protection()).alias(value))
