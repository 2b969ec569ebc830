"""Frames that arrive over time: each pixel's best frame so far, as a stream.

The state is one struct for each pixel, whatever the number of frames, so it
is kept without expiry; late frames are frames like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def best_so_far(scores: DataFrame, keys: list[str]) -> DataFrame:
    """scores: ``keys``, ``y``, ``x``, ``frame``, ``score``.  Equal scores go to the smaller frame; null and negative scores never win."""
    best = F.max(F.struct("score", (-F.col("frame")).alias("back")))
    rows = scores.filter("score >= 0").groupBy(*keys, "y", "x").agg(best.alias("best"), F.count("*").alias("seen"))
    return rows.select(*keys, "y", "x", (-F.col("best.back")).alias("frame"), F.col("best.score").alias("score"), "seen")


def settled(spark: SparkSession, folder: str, schema: str, keys: list[str], at: str, files: int = 1) -> DataFrame:
    """Run the stream of the Parquet files of scores in ``folder``, ``files`` a batch, until there are no more: the best so far, as it then is.

    at: a folder for progress and the last answer; the same one goes on where it stopped.
    """
    scores = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    best = best_so_far(scores, keys)
    (
        best.writeStream.outputMode("complete")
        .option("checkpointLocation", f"{at}/progress")
        .foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{at}/best"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema(best.schema).parquet(f"{at}/best")
