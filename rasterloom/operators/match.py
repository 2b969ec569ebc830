"""Matching and its statistics: ratio-tested neighbours, correlation, medians, normal equations, quality figures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Features of either side that one task compares.
BLOCK = 2048


def ratio_matches(left: DataFrame, right: DataFrame, by: list[str], ratio: float = 0.75) -> DataFrame:
    """left, right: ``id`` and ``features`` within groups ``by`` (a pair of frames).  Pairs whose nearest beats the second by the ratio.

    Either side is cut into blocks, and each pair of blocks is compared by one matrix product in a task; two candidates
    of each left feature come out of a pair of blocks, so pairs are never rows.
    """
    def sided(df: DataFrame, name: str) -> DataFrame:
        count = df.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name + "s"))
        rows = df.select(*by, F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features")).join(count, by)
        return rows.withColumn(name, F.pmod(F.xxhash64("id"), F.col(name + "s")).cast("int"))

    one, other = sided(left, "p"), sided(right, "q")
    sizes = one.select(*by, "ps").distinct().join(other.select(*by, "qs").distinct(), by)
    copies = lambda df, n, name: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    rows = copies(one.join(sizes.drop("ps"), by), "qs", "q").select(*by, "p", "q", F.lit(True).alias("left"), "id", "features")
    rows = rows.unionByName(copies(other.join(sizes.drop("qs"), by), "ps", "p").select(*by, "p", "q", F.lit(False).alias("left"), "id", "features"))

    def run(table: pa.Table) -> pa.Table:
        ids, is_left = table.column("id").to_numpy(), table.column("left").to_numpy()
        words = table.column("features").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")  # ties go to the smaller id
        ids, is_left, words = ids[order], is_left[order], words[order]
        a, b, near, far = words[is_left], words[~is_left], ids[is_left], ids[~is_left]
        found = np.empty((0, 2), int)
        if len(a) and len(b):
            square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
            few = np.argpartition(square, min(3, len(b) - 1), axis=1)[:, :4]
            exact = np.sqrt(((a[:, None, :] - b[few]) ** 2).sum(2))
            best = np.lexsort((few, exact))[:, :2]
            found, exact = np.take_along_axis(few, best, 1), np.take_along_axis(exact, best, 1)
        keys = {k: pa.array([table.column(k)[0].as_py()] * found.size, table.schema.field(k).type) for k in by}
        return pa.table({**keys, "left_id": pa.array(np.repeat(near, found.shape[1] if len(found) else 0)), "right_id": pa.array(far[found.reshape(-1)]), "distance": pa.array(exact.reshape(-1) if len(found) else np.empty(0))})

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in left.select(*by).schema.fields)
    two = rows.groupBy(*by, "p", "q").applyInArrow(run, f"{types}, left_id long, right_id long, distance double")
    best = F.slice(F.array_sort(F.collect_list(F.struct("distance", "right_id"))), 1, 2)  # of two from each block
    near = two.groupBy(*by, "left_id").agg(best.alias("b")).select(*by, "left_id", F.col("b")[0]["right_id"].alias("right_id"), F.col("b")[0]["distance"].alias("d1"), F.get("b", F.lit(1))["distance"].alias("d2"))
    return near.filter(F.col("d1") < ratio * F.col("d2"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's, 0 where it is not defined."""
    return F.coalesce(F.nanvl(F.corr(a, b), F.lit(0.0)), F.lit(0.0))


def median_shift(matches: DataFrame, keys: list[str]) -> DataFrame:
    """The median offset of inliers along each axis."""
    return matches.filter("inlier").groupBy(*keys).agg(F.median("dx").alias("dx"), F.median("dy").alias("dy"), F.count("*").alias("inliers"))


def normal_equations(rows: DataFrame, keys: list[str], jacobian: list[str], residual: str) -> DataFrame:
    """The sums of products that least squares needs, ``damping`` still to be added: one pass, partial sums first."""
    n = len(jacobian)
    products = [F.sum(F.col(jacobian[i]) * F.col(jacobian[j])).alias(f"h{i}{j}") for i in range(n) for j in range(i, n)]
    return rows.groupBy(*keys).agg(*products, *[F.sum(F.col(jacobian[i]) * F.col(residual)).alias(f"g{i}") for i in range(n)])


def steps(equations: DataFrame, damping: float = 1e-3) -> DataFrame:
    """The damped least-squares step of two-parameter equations: adds ``d0`` and ``d1``."""
    a, b, c, p, q = F.col("h00") + damping, F.col("h01"), F.col("h11") + damping, F.col("g0"), F.col("g1")
    det = a * c - b * b
    return equations.withColumns({"d0": (c * p - b * q) / det, "d1": (a * q - b * p) / det})


def quality(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows: ``got``, ``want``, ``near_edge``, ``thin``.  Mean squared errors, over all and over two masks."""
    e = (F.col("got") - F.col("want")).cast("double") ** 2
    return rows.groupBy(*keys).agg(F.avg(e).alias("mse"), F.avg(F.when(F.col("near_edge"), e)).alias("halo_mse"), F.avg(F.when(F.col("thin"), e)).alias("thin_mse"))


def seam(one: DataFrame, other: DataFrame, keys: list[str], value: str) -> DataFrame:
    both = one.join(other.select(*keys, "y", "x", F.col(value).alias("other")), [*keys, "y", "x"])
    return both.groupBy(*keys).agg(F.max(F.abs(F.col(value) - F.col("other"))).alias("seam_max"))


def best(rows: DataFrame, keys: list[str], score: str, order: str, *more: str) -> DataFrame:
    """The row of each key with the largest score, the first in ``order`` (a whole number) of equals; partial maxima before the shuffle."""
    top = F.max(F.struct(score, (-F.col(order)).alias("back"), *more)).alias("b")
    return rows.groupBy(*keys).agg(top).select(*keys, F.col(f"b.{score}").alias(score), (-F.col("b.back")).alias(order), *[F.col(f"b.{c}").alias(c) for c in more])


def accepted(rows: DataFrame) -> DataFrame:
    """Adds whether an alignment stands: by phase response, by matches and inliers, and by its final score."""
    phase = F.col("response") >= 0.08
    features = (F.col("matches") >= 6) & (F.col("inliers") >= 6) & (F.col("inliers") / F.col("matches") >= 0.25)
    return rows.withColumns({"by_phase": phase, "by_features": features, "accepted": (phase | features) & (F.col("score") >= 0.2)})
