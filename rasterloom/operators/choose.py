"""Which frame a pixel is taken from: ranks, winners, confidence, clean-up of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.pixel import replicate
from rasterloom.operators import axis

NO_SCORE = -1.0


def ranked(scores: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """The k best frames of each pixel, ties by frame number: columns ``score``, ``frame``, ``rank``."""
    w = Window.partitionBy(*keys, "y", "x").orderBy(F.desc("score"), "frame")
    return scores.filter(F.col("score") > NO_SCORE).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def cascade(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The three slots that frames leave when each is inserted in turn and only a strictly better one moves down.

    Differs from ``ranked`` in the runners-up of ties only.  ``c``: three
    structs of score and frame; an empty slot has score -1 and frame 0.
    """
    empty = "named_struct('score', -1d, 'frame', 0L)"
    fold = f"""aggregate(array_sort(collect_list(struct(frame, score))), array({empty}, {empty}, {empty}), (a, e) ->
      CASE WHEN e.score > a[0].score THEN array(named_struct('score', e.score, 'frame', e.frame), CASE WHEN a[0].score > a[1].score THEN a[0] ELSE a[1] END,
          CASE WHEN a[0].score > a[1].score THEN CASE WHEN a[1].score > a[2].score THEN a[1] ELSE a[2] END WHEN a[0].score > a[2].score THEN a[0] ELSE a[2] END)
        WHEN e.score > a[1].score THEN array(a[0], named_struct('score', e.score, 'frame', e.frame), CASE WHEN a[1].score > a[2].score THEN a[1] ELSE a[2] END)
        WHEN e.score > a[2].score THEN array(a[0], a[1], named_struct('score', e.score, 'frame', e.frame)) ELSE a END)"""
    rows = scores.filter(F.col("score") > NO_SCORE).select(*keys, "y", "x", F.col("frame").cast("long").alias("frame"), F.col("score").cast("double").alias("score"))
    return rows.groupBy(*keys, "y", "x").agg(F.expr(fold).alias("c"))


def winner(scores: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """The best frame, the earliest of equals, with its other columns; one pass, partial maxima before the shuffle."""
    best = F.max(F.struct("score", (-F.col("frame")).alias("minus"), *more)).alias("b")
    rows = scores.filter(F.col("score") > NO_SCORE).groupBy(*keys, "y", "x").agg(best)
    return rows.select(*keys, "y", "x", F.col("b.score").alias("score"), (-F.col("b.minus")).alias("frame"), *[F.col(f"b.{c}").alias(c) for c in more])


def confidence_of(first: Column, second: Column) -> Column:
    gap = F.greatest(first, F.lit(0.0)) - F.greatest(F.coalesce(second, F.lit(NO_SCORE)), F.lit(0.0))
    return F.least(F.greatest(gap / F.greatest(first, F.lit(1e-8)), F.lit(0.0)), F.lit(1.0))


def labels(scores: DataFrame, keys: list[str]) -> DataFrame:
    """``label`` and ``confidence`` of each pixel, and ``best``, the frames in its three slots (as ``cascade`` leaves them)."""
    c = F.col("c")
    best = F.transform(F.filter(c, lambda s: s["score"] >= 0), lambda s: s["frame"])
    return cascade(scores, keys).select(*keys, "y", "x", c[0]["frame"].alias("label"), confidence_of(c[0]["score"], c[1]["score"]).alias("confidence"), best.alias("best"))


def median3(df: DataFrame, keys: list[str], label: str, h: int, w: int) -> DataFrame:
    """The median of the nine labels around each pixel, borders repeated."""
    middle = lambda v: F.element_at(F.array_sort(F.collect_list(v)), 5)
    return axis.neighbours(df, keys, F.col(label), h, w, 1, middle, replicate).withColumnRenamed("v", "median")


def cleaned(rows: DataFrame, keys: list[str], h: int, w: int, below: float = 0.2, edge: float | None = 0.35) -> DataFrame:
    """Labels of low confidence replaced by their neighbours' median.

    With ``edge`` (rows then have ``edge`` and ``best``) only off edges and only by a frame among the pixel's best.
    """
    both = rows.join(median3(rows, keys, "label", h, w), [*keys, "y", "x"])
    change = F.col("confidence") < below
    if edge is not None:
        change = change & (F.col("edge") < edge) & F.array_contains("best", F.col("median"))
    return both.withColumn("label", F.when(change, F.col("median")).otherwise(F.col("label")))


def eroded(valid: DataFrame, keys: list[str], column: str, h: int, w: int, support: int) -> DataFrame:
    """The minimum over the square around each pixel of a dense raster; outside counts as valid."""
    rows = valid
    for over, along in (("y", "x"), ("x", "y")):
        frame = Window.partitionBy(*keys, over).orderBy(along).rowsBetween(-support, support)
        rows = rows.withColumn(column, F.min(column).over(frame))
    return rows
