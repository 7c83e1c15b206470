"""The registry over a stream, with a restart, against the registry of all rows."""

from pyspark.sql import functions as F

from lodestone.streaming import mentions


def run(spark, source, sink, checkpoint, **args):
    """What a stream over the files that are there adds to the sink."""
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = mentions.registry_stream(stream, "user_id", "ts", "event_id", "event_type", 5, 3, **args)
    write = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(sink)
    q = out.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_three_files_with_a_restart_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "event_type")
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for n in (2, 0):  # the latest events first: rows come in any order
        events.filter(F.col("event_id") % 3 == n).coalesce(1).write.mode("append").parquet(source)
    run(spark, source, sink, checkpoint)
    events.filter("event_id % 3 = 1").coalesce(1).write.mode("append").parquet(source)
    run(spark, source, sink, checkpoint)
    got = spark.read.parquet(sink).groupBy("user_id").agg(F.max_by(F.struct("mentions", "kept", "oldest_kept", "ring"), "batch").alias("r")).select("user_id", "r.*")
    want = mentions.registry(events, "user_id", "ts", "event_id", "event_type", 5, 3)
    rows = lambda df: {tuple(r) for r in df.select("user_id", "mentions", "kept", "oldest_kept", "ring").collect()}
    assert rows(got) == rows(want) and got.count() > 10


def test_idle_entities_are_evicted(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for n, rows in enumerate(([(1, "2024-01-01 00:00:00", 7, "a"), (2, "2024-01-01 00:30:00", 8, "b")], [(3, "2024-01-03 00:00:00", 8, "c")], [(4, "2024-01-03 01:00:00", 7, "d")])):
        made = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
        made.coalesce(1).write.mode("append").parquet(source)
        run(spark, source, sink, checkpoint, idle="1 day", late="1 hour")
    found = {(r.user_id, r.mentions, r.ring, r.evicted) for r in spark.read.parquet(sink).collect()}
    assert (7, 1, "a", True) in found and (8, 2, "c,b", False) in found and (7, 1, "d", False) in found
