"""Frames as a stream against the same frames at once."""

from rasterloom.operators import choose
from rasterloom.streaming import arrivals


def test_stream_equals_batch(spark, tmp_path):
    rows = [(0, y, x, f, float((y * 7 + x * 5 + f * 3) % 4 - 1)) for f in range(6) for y in range(3) for x in range(3)]
    schema = "stack int, y int, x int, frame int, score double"
    for f in range(6):
        spark.createDataFrame([r for r in rows if r[3] == f], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = arrivals.best_so_far(stream, ["stack"]).writeStream.outputMode("complete").format("memory").queryName("best_frames").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.y, r.x): (r.frame, r.score) for r in spark.table("best_frames").collect()}
    want = {(r.y, r.x): (r.frame, r.score) for r in choose.winner(spark.createDataFrame(rows, schema).filter("score >= 0"), ["stack"]).collect()}
    assert got == want
