"""Similarity transforms (2 x 3, as six columns a b c d e f: x' = a x + b y + c, y' = d x + e y + f) and warps."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import arrays, register

M = ("a", "b", "c", "d", "e", "f")


def inverse(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> dict[str, Column]:
    det = a * e - b * d
    ia, ib, id_, ie = e / det, -b / det, -d / det, a / det
    return {"a": ia, "b": ib, "c": -(ia * c + ib * f), "d": id_, "e": ie, "f": -(id_ * c + ie * f)}


def rescaled(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column, sx: float, sy: float) -> dict[str, Column]:
    """The same motion on a raster that is sx by sy times as large."""
    return {"a": a * 1.0, "b": b * sx / sy, "c": c * sx, "d": d * sy / sx, "e": e * 1.0, "f": f * sy}


def similar(a: Column, b: Column, d: Column, e: Column) -> tuple[Column, Column]:
    """The nearest rotation and scale: its cosine and sine parts."""
    return (a + e) / 2, (d - b) / 2


def singular(a: Column, b: Column, d: Column, e: Column) -> tuple[Column, Column]:
    """The singular values of the linear part, larger first, in closed form."""
    p, q = F.sqrt((a + e) ** 2 + (d - b) ** 2), F.sqrt((a - e) ** 2 + (d + b) ** 2)
    return (p + q) / 2, F.abs(p - q) / 2


def verdict(rows: DataFrame) -> DataFrame:
    """Adds ``reason``: why a transform is rejected, or null.  (What depends on the frame's size is judged by ``overlap``.)"""
    a, b, c, d, e, f = (F.col(x) for x in M)
    finite = ~F.greatest(*[F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull() for x in (a, b, c, d, e, f)])
    large, small = singular(a, b, d, e)
    turn = F.degrees(F.atan2(d - b, a + e))
    reason = (
        F.when(~finite, "not finite").when(a * e - b * d <= 0, "mirrored").when((large > 1.25) | (small < 0.8), "scale")
        .when(large / small > 1.03, "sheared").when(F.abs(turn) > 15, "rotation")
    )
    return rows.withColumns({"reason": reason, "scale": F.sqrt(F.abs(a * e - b * d)), "rotation": turn})


def overlap(rows: DataFrame, h: int, w: int) -> DataFrame:
    """Adds ``overlap``, which part of the reference a frame of h x w covers once it is carried there, and ``apart``, whether that is too little."""
    @F.pandas_udf("double")
    def part(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, f: pd.Series) -> pd.Series:
        matrices = np.column_stack([a, b, c, d, e, f]).reshape(-1, 2, 3)
        return pd.Series([register.overlap(m, h, w) if np.isfinite(m).all() else 0.0 for m in matrices])

    return rows.withColumn("overlap", part(*[F.col(m) for m in M])).withColumn("apart", F.col("overlap") < register.OVERLAP)


def warped(pixels: DataFrame, transforms: DataFrame, keys: list[str], value: str, h: int, w: int, side: int = 256) -> DataFrame:
    """Each frame drawn on the reference's places: bilinear, borders repeated; ``valid`` within 1e-4 of the source.

    transforms: one row for each frame, source to reference; places are mapped by the inverse.  The result is cut into
    blocks; each asks for the source blocks under its corners (an equi-join on block numbers), and is drawn in a task.
    """
    inv = transforms.select(*keys, *[v.alias("m" + k) for k, v in inverse(*[F.col(m) for m in M]).items()])
    across, down = -(-w // side), -(-h // side)
    asked = inv.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(across * down - 1))))
    asked = asked.withColumns({"ty": F.expr(f"cast(block div {across} as int)"), "tx": F.expr(f"cast(block % {across} as int)")})
    corners = [(y, x) for y in (f"ty * {side}", f"least(ty * {side} + {side}, {h}) - 1") for x in (f"tx * {side}", f"least(tx * {side} + {side}, {w}) - 1")]
    for name, (p, q, r), n in (("sx", "abc", w), ("sy", "def", h)):
        at = ", ".join(f"m{p} * ({x}) + m{q} * ({y}) + m{r}" for y, x in corners)
        first, last = f"floor(least({at})) - 1", f"ceil(greatest({at})) + 1"
        asked = asked.withColumn(name, F.explode(F.expr(f"sequence(cast(greatest(least({first}, {n - 1}), 0) div {side} as int), cast(least(greatest({last}, 0), {n - 1}) div {side} as int))")))
    source = pixels.select(*keys, "y", "x", F.col(value).cast("double").alias("value")).withColumns({"sy": F.expr(f"cast(y div {side} as int)"), "sx": F.expr(f"cast(x div {side} as int)")})
    names = [f"m{k}" for k in M]
    rows = source.join(asked, [*keys, "sy", "sx"]).select(*keys, "ty", "tx", *names, "y", "x", "value")

    def draw(table: pa.Table) -> pa.Table:
        y, x, v = (table.column(c).to_numpy() for c in ("y", "x", "value"))
        block = np.zeros((y.max() + 1 - y.min(), x.max() + 1 - x.min()))
        block[y - y.min(), x - x.min()] = v
        row = {c: table.column(c)[0].as_py() for c in (*keys, "ty", "tx", *names)}
        box = (row["ty"] * side, min(row["ty"] * side + side, h), row["tx"] * side, min(row["tx"] * side + side, w))
        out, valid = arrays.warped(block, np.array([row[n] for n in names]).reshape(2, 3), box, (int(y.min()), int(x.min())), (h, w))
        oy, ox = np.mgrid[box[0] : box[1], box[2] : box[3]].astype(np.int32)
        own = {k: pa.array([row[k]] * out.size, table.schema.field(k).type) for k in keys}
        return pa.table({**own, "y": pa.array(oy.ravel()), "x": pa.array(ox.ravel()), "valid": pa.array(valid.ravel()), value: pa.array(out.ravel())})

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pixels.select(*keys).schema.fields)
    return rows.groupBy(*keys, "ty", "tx").applyInArrow(draw, f"{types}, y int, x int, valid boolean, {value} double")
