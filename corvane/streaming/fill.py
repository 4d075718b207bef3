"""Incremental fill as a stream: chunks of new or changed documents, appended once per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.functions.text import split_chunks
from corvane.operators.retrieval import topic_encoder


def fill(docs: DataFrame, path: str, checkpoint: str, size: int = 500, overlap: int = 50, topics: tuple[str, ...] = ("the", "der")) -> StreamingQuery:
    """Encode the stream docs(doc, content, revision) into path until its source is used up.

    A micro-batch overwrites its own folder, so one that runs again after a failure leaves nothing twice. The current
    state is read by `current`.
    """

    def save(batch: DataFrame, number: int) -> None:
        chunks = batch.select("doc", "revision", F.explode(split_chunks(F.col("content"), size, overlap)).alias("c"))
        vectors = chunks.select("doc", "revision", F.col("c.idx").alias("chunk_index"), topic_encoder(F.col("c.text"), list(topics)).alias("embedding"), F.lit(number).cast("long").alias("run"))
        vectors.write.mode("overwrite").parquet(f"{path}/run={number}")

    return docs.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(vectors: DataFrame) -> DataFrame:
    """Vectors of the latest run of each document; documents are re-encoded as a whole."""
    last = vectors.groupBy("doc").agg(F.max("run").alias("run"))
    return vectors.join(last, ["doc", "run"])
