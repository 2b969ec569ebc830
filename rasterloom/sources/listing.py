"""Stacks as tables of headers: discovery, validation, guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def deduplicated(paths: DataFrame) -> DataFrame:
    """paths: ``path`` and ``ordinal``.  Each path once, at its first place, numbered anew; in one task, for a stack has at most 65535."""
    first = paths.groupBy("path").agg(F.min("ordinal").alias("ordinal"))
    return first.select("path", (F.row_number().over(Window.orderBy("ordinal")) - 1).cast("long").alias("frame"))


def prefix(frames: DataFrame, n: int) -> DataFrame:
    """The first n frames of each stack."""
    return frames.filter(F.col("frame") < n)


def violations(frames: DataFrame) -> DataFrame:
    """Frames that differ from frame 0 of their stack in size, depth or profile, and in what."""
    first = frames.filter("frame = 0").select("stack", F.col("h").alias("h0"), F.col("w").alias("w0"), F.col("depth").alias("depth0"), F.col("icc").alias("icc0"))
    rows = frames.filter("frame > 0").join(first, "stack")
    what = F.when((F.col("h") != F.col("h0")) | (F.col("w") != F.col("w0")), "shape").when(F.col("depth") != F.col("depth0"), "depth").when(~F.col("icc").eqNullSafe(F.col("icc0")), "profile")
    return rows.select("stack", "frame", what.alias("reason")).filter("reason is not null")


def clashes(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Outputs that are inputs too."""
    return outputs.join(inputs, "path", "left_semi")


def header_reason(pages: str = "pages", photometric: str = "photometric", planar: str = "planar", samples: str = "samples", bits: str = "bits", orientation: str = "orientation"):
    """Why a header is refused, or null."""
    c = F.col
    return (
        F.when(c(pages) != 1, "pages").when(c(photometric) != 2, "not RGB").when(c(planar) != 1, "planar").when(c(samples) != 3, "samples")
        .when(~c(bits).isin(8, 16), "depth").when(~c(orientation).between(1, 8), "orientation")
    )


def size_in_bytes(text):
    """``1.5GiB``, ``512M`` and the like, as bytes; null if it is no size or under 64 MiB."""
    p = r"^\s*([0-9]+(\.[0-9]+)?)\s*([KMGT]?)(I?B)?\s*$"
    upper = F.upper(text)
    unit = F.regexp_extract(upper, p, 3)
    factor = F.when(unit == "K", 2.0**10).when(unit == "M", 2.0**20).when(unit == "G", 2.0**30).when(unit == "T", 2.0**40).otherwise(1.0)
    n = F.floor(F.expr("try_cast(1 as double)") * F.regexp_extract(upper, p, 1).try_cast("double") * factor).cast("long")
    return F.when(upper.rlike(p) & (n >= 1 << 26), n)
