"""Counts over a stream of files equal those over all rows at once."""

from pyspark.sql import functions as F

from seqlytics.streaming import counters


def test_counts(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", F.col("user_id").alias("value"))
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = counters.running_counts(stream).writeStream.format("memory").queryName("so_far").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    want = {tuple(r) for r in events.groupBy("value").count().collect()}
    assert {tuple(r) for r in spark.table("so_far").collect()} == want


def test_windows_are_closed_by_the_watermark(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", F.col("user_id").alias("value"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = counters.windowed_counts(stream, lateness="0 seconds").writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    out.awaitTermination(60)
    want = {(r[0], r[1]): r[2] for r in events.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")), "value").count().collect()}
    got = spark.table("closed").collect()
    assert got and all(want[(r["start"], r["value"])] == r["frequency"] for r in got)
