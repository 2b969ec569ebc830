"""Focus measures: derivatives, energies, noise, coherence, contrast and the scores made of them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import axis
from rasterloom.sources.scratch import held

SOBEL = {"gx": axis.outer(axis.BELL, axis.RISE), "gy": axis.outer(axis.RISE, axis.BELL)}
LAPLACE = {"lap": {(0, 0): -4.0, (0, 1): 1.0, (0, -1): 1.0, (1, 0): 1.0, (-1, 0): 1.0}}
MIXED = {"mixed": axis.outer(axis.STEP, axis.STEP)}
#: (support, sigma, weight) of the photographic score's scales; the last only at the highest quality.
SCALES = [(1, 0.7, 1.0), (3, 1.0, 0.7), (6, 2.0, 0.4)]


def sobel(df: DataFrame, keys: list[str], value: Column, h: int, w: int) -> DataFrame:
    return axis.several(df, keys, value, h, w, SOBEL)


def energy(df: DataFrame, keys: list[str], value: Column, h: int, w: int) -> DataFrame:
    """Squared gradient."""
    return sobel(df, keys, value, h, w).select(*keys, "y", "x", (F.col("gx") ** 2 + F.col("gy") ** 2).alias("energy"))


def smooth(df: DataFrame, keys: list[str], value: Column, name: str, h: int, w: int, radius: int) -> DataFrame:
    k = axis.gaussian(radius)
    return axis.filtered(df, keys, value, name, h, w, k, k)


def tenengrad(df: DataFrame, keys: list[str], value: Column, h: int, w: int, radius: int) -> DataFrame:
    return smooth(energy(df, keys, value, h, w), keys, F.col("energy"), "score", h, w, radius)


def standard_score(df: DataFrame, keys: list[str], value: Column, h: int, w: int, radius: int = 3, multiscale: bool = False) -> DataFrame:
    fine = tenengrad(df, keys, value, h, w, radius)
    if not multiscale:
        return fine
    soft = smooth(df, keys, value, "v", h, w, 3)
    coarse = tenengrad(soft, keys, F.col("v"), h, w, 2 * radius).withColumnRenamed("score", "coarse")
    return fine.join(coarse, [*keys, "y", "x"]).select(*keys, "y", "x", (F.col("score") + F.col("coarse") * 0.5).alias("score"))


def structure(df: DataFrame, keys: list[str], value: Column, h: int, w: int, radius: int) -> DataFrame:
    """coherence of the smoothed gradient products, the noise floor, and the smoothed mixed difference."""
    kernels = {**SOBEL, **MIXED}
    g = axis.several(df, keys, value, h, w, kernels)
    products = {"xx": F.col("gx") ** 2, "yy": F.col("gy") ** 2, "xy": F.col("gx") * F.col("gy"), "m2": F.col("mixed") ** 2}
    spark, weights = df.sparkSession, axis.gaussian(radius)
    rows = axis.along(g, axis.taps(spark, w, weights), "x", [*keys, "y"], products, w)
    rows = axis.along(rows, axis.taps(spark, h, weights), "y", [*keys, "x"], {k: F.col(k) for k in products}, h)
    coherence = F.sqrt((F.col("xx") - F.col("yy")) ** 2 + 4 * F.col("xy") ** 2) / F.greatest(F.col("xx") + F.col("yy"), F.lit(1.0))
    rows = rows.withColumn("coherence", coherence)
    return rows.select(*keys, "y", "x", "coherence", (0.25 * F.col("m2") * F.greatest(1 - F.col("coherence") ** 2, F.lit(0.0))).alias("noise"))


def contrast(df: DataFrame, keys: list[str], value: Column, h: int, w: int, radius: int) -> DataFrame:
    """Local variance against noise: near 1 in texture, near 0 in flat or noisy places."""
    spark, weights = df.sparkSession, axis.gaussian(radius)
    rows = df.select(*keys, "y", "x", value.cast("double").alias("g"))
    rows = axis.along(rows, axis.taps(spark, w, weights), "x", [*keys, "y"], {"m": F.col("g"), "s": F.col("g") ** 2}, w)
    rows = axis.along(rows, axis.taps(spark, h, weights), "y", [*keys, "x"], {"m": F.col("m"), "s": F.col("s")}, h)
    rows = rows.join(structure(df, keys, value, h, w, radius), [*keys, "y", "x"])
    rows = rows.withColumn("variance", F.greatest(F.col("s") - F.col("m") ** 2, F.lit(0.0)))
    return rows.select(*keys, "y", "x", "variance", "noise", (F.col("variance") / (F.col("variance") + 2 * F.col("noise") + 1024)).alias("contrast"))


def bell(support: int, sigma: float) -> dict[int, float]:
    """A Gaussian's taps up to ``support``."""
    raw = {d: math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-support, support + 1)}
    return {d: v / sum(raw.values()) for d, v in raw.items()}


def reach(support: int, radius: int) -> int:
    """The radius over which a scale's evidence is gathered."""
    return radius if support == 1 else 2 * radius


def noise_gain(support: int, sigma: float) -> float:
    """What white noise of variance 1 adds to the squared gradient behind a smoothing of this support."""
    g = list(bell(support, sigma).values())
    return float(2 * (np.convolve(g, [-1, 0, 1]) ** 2).sum() * (np.convolve(g, [1, 2, 1]) ** 2).sum())


def photographic_score(df: DataFrame, keys: list[str], value: Column, h: int, w: int, radius: int = 3, best: bool = False) -> DataFrame:
    """For each scale: gradient energy less what noise explains, with a Laplacian bonus; their weighted sum times contrast."""
    place = [*keys, "y", "x"]
    parts = held(contrast(df, keys, value, h, w, radius), "contrast")
    total = F.lit(0.0)
    for r in (radius, 2 * radius):
        parts = parts.join(smooth(parts, keys, F.col("noise"), f"noise{r}", h, w, r), place)
    for k, (support, sigma, weight) in enumerate(SCALES if best else SCALES[:2]):
        wide = reach(support, radius)
        kernel = bell(support, sigma)
        soft = held(axis.filtered(df, keys, value, "v", h, w, kernel, kernel), "scale")
        e = smooth(energy(soft, keys, F.col("v"), h, w), keys, F.col("energy"), f"e{k}", h, w, wide)
        lap = smooth(axis.several(soft, keys, F.col("v"), h, w, LAPLACE), keys, F.col("lap") ** 2, f"lap{k}", h, w, wide)
        parts = parts.join(e, place).join(lap, place)
        gain = F.greatest(F.col(f"e{k}") - 1.5 * noise_gain(support, sigma) * F.col(f"noise{wide}"), F.lit(0.0))
        total = total + weight * (gain + 0.2 * F.greatest(F.col(f"lap{k}") - 0.5 * F.col("noise"), F.lit(0.0)))
    return parts.select(*keys, "y", "x", (total * F.col("contrast")).alias("score"))


def edge_strength(df: DataFrame, keys: list[str], value: Column, h: int, w: int) -> DataFrame:
    g = F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2) / 16000
    return sobel(df, keys, value, h, w).select(*keys, "y", "x", F.least(g, F.lit(1.0)).alias("edge"))
