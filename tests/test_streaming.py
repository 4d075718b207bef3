"""Streams give what their batch twins give."""

from pyspark.sql import functions as F

from corvane.functions.text import split_chunks
from corvane.streaming import fill, health


def test_fill(spark, tmp_path):
    docs = spark.range(20).select(F.col("id").alias("doc"), F.concat(F.lit("the text "), F.col("id")).alias("content"), F.lit(1).cast("long").alias("revision"))
    docs.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):
        fill.fill(stream(), f"{tmp_path}/out", f"{tmp_path}/ck", 6, 1).awaitTermination()
        docs.filter("doc < 5").withColumn("content", F.lit("new words of it")).withColumn("revision", F.lit(2).cast("long")).write.mode("append").parquet(f"{tmp_path}/in")
    got = fill.current(spark.read.parquet(f"{tmp_path}/out"))
    want = docs.withColumn("content", F.when(F.col("doc") < 5, "new words of it").otherwise(F.col("content"))).select("doc", F.explode(split_chunks(F.col("content"), 6, 1)).alias("c")).select("doc", F.col("c.idx").alias("chunk_index"))
    assert sorted(map(tuple, got.select("doc", "chunk_index").collect())) == sorted(map(tuple, want.collect()))
    assert {r.revision for r in got.filter("doc < 5").collect()} == {2}


def test_health(spark, tmp_path):
    rows = [("a", 1, False), ("a", 2, True), ("b", 1, True), ("b", 3, False), ("b", 2, True)]
    events = spark.createDataFrame(rows, "store string, seq long, ok boolean")
    events.write.parquet(f"{tmp_path}/in")
    q = health.track_health(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")).writeStream.outputMode("update").format("memory").queryName("health").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("health").collect())) == sorted((r.store, r.ok, r.seq) for r in health.latest_health(events).collect())
