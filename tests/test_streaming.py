"""Windowed rates of a stream equal those of the batch."""

from pyspark.sql import functions as F

from respanel.streaming import online


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    folder = str(tmp_path / "in")
    events.repartition(3).write.parquet(folder)
    answers = lambda df: df.select("event_type", F.col("ts").cast("timestamp").alias("ts"), (F.col("value") >= 10).cast("int").alias("obs"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    rates = online.windowed_rates(answers(stream), "event_type", "ts", late="3650 days")
    query = rates.writeStream.outputMode("complete").format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r.event_type, r.window.start): (r.n, r.n_correct) for r in spark.table("rates").collect()}
    want = {(r.event_type, r.window.start): (r.n, r.n_correct) for r in online.windowed_rates(answers(events), "event_type", "ts").collect()}
    assert got == want and len(want) > 10
    running = online.running_rates(answers(events), "event_type", "ts").groupBy("event_type").agg(F.max("n").alias("n")).collect()
    assert sum(r.n for r in running) == events.count()
