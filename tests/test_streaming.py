"""Streams against the batch forms."""

from pyspark.sql import functions as F

from leafgraph.operators import progress
from leafgraph.streaming import progress as streams

SAMPLES = [(1, 0.1, 0.5), (1, 0.1, 2.0), (1, 0.2, 4.0), (2, 0.3, 1.0), (1, 0.5, 4.1), (2, 0.9, 3.0), (1, 0.9, 18.0), (1, 0.85, 18.2), (3, 0.001, 5.0)]


def last_rows(spark, tmp_path, make, value):
    folder = str(tmp_path / "in")
    for k in range(0, len(SAMPLES), 3):  # three files, one a trigger
        spark.createDataFrame(SAMPLES[k : k + 3], "run int, fraction double, t double").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("run int, fraction double, t double").option("maxFilesPerTrigger", 1).parquet(folder)
    seen = {}

    def keep(batch, _):
        for r in batch.collect():
            seen[r.run] = r[value]

    query = make(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return seen


def test_running_progress(spark, tmp_path):
    got = last_rows(spark, tmp_path, streams.running_progress, "progress")
    assert got == {1: 0.9, 2: 0.9, 3: 0.001}


def test_time_left(spark, tmp_path):
    got = last_rows(spark, tmp_path, streams.time_left, "left")
    rows = spark.createDataFrame(SAMPLES, "run int, fraction double, t double").groupBy("run").agg(F.sort_array(F.collect_list(F.struct("t", "fraction"))).alias("s"))
    want = {r.run: r.left for r in rows.select("run", progress.time_left(F.col("s")).alias("left")).collect()}
    assert got.keys() == want.keys() and want[1] is not None
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-9) for k in want)
