from pyspark.sql import functions as F

from plumbline.streaming import events as se


def prepared(spark, sf, path):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts")
    e.coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def test_windowed_counts_equal_batch(spark, sf, tmp_path):
    batch = prepared(spark, sf, f"{tmp_path}/in")
    stream = se.windowed_counts(se.read_events(spark, f"{tmp_path}/in", batch.schema), "ts", "event_type", late="40 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    want = batch.groupBy("event_type", F.window("ts", "7 days").alias("w")).count().select("event_type", "w.start", "count")
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, want.collect()))


def test_latest_by_key(spark, sf, tmp_path):
    batch = prepared(spark, sf, f"{tmp_path}/in").select("user_id", "event_id", "ts")
    full = spark.read.parquet(f"{tmp_path}/in")
    source = se.read_events(spark, f"{tmp_path}/in", full.schema).select("user_id", "event_id", "ts")
    q = source.writeStream.foreachBatch(se.latest_by_key(["user_id"], "ts", f"{tmp_path}/store")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.user_id: r.ts for r in spark.read.parquet(f"{tmp_path}/store/0").collect()}
    assert got == {r.user_id: r.m for r in batch.groupBy("user_id").agg(F.max("ts").alias("m")).collect()}
