"""Streams: windowed event counts, and refreshing resolved metrics from arriving candidate files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from granary.operators.resolve import pivot, resolve
from granary.sources import versions


def windowed_counts(events: DataFrame, late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """start, event_type, n per window; ``ts`` is cast, as watermarks need time zones."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Runs a stream over what is there, into ``path``: each batch adds the rows that it changed under its own
    number, so repeating one changes nothing, and windows past the watermark leave the state. See ``latest``."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return q


def latest(spark: SparkSession, path: str, keys: list[str], values: list[str]) -> DataFrame:
    """What stands after the last batch: of each key the row of the latest batch that changed it."""
    return spark.read.parquet(path).groupBy(*keys).agg(*[F.max_by(v, "batch").alias(v) for v in values])


def refresh(spark: SparkSession, incoming: str, schema: StructType, folder: str, checkpoint: str) -> StreamingQuery:
    """Candidate files in, resolved and pivoted metrics out (tables ``candidates``, ``resolved`` and ``pivot`` of the
    versioned store ``folder``). A file holds all candidates of the documents that it names: of a document that
    is sent again those of the latest batch stand, and what was there before goes, in all three tables at once.
    Within a batch its files count together. A repeated batch leaves the same rows, and one that comes after a
    later one for the same document is told by its number and changes nothing."""
    names = [f.name for f in schema]

    def put(batch: DataFrame, number: int) -> None:
        own = batch.withColumn("batch", F.lit(number))
        known = versions.read(spark, folder, "candidates")
        if known is not None:
            newer = known.filter(F.col("batch") > number).select("doc_id").distinct()
            own = own.join(newer, "doc_id", "left_anti").select(*names, "batch")
        versions.replace(spark, folder, {"candidates": own, "resolved": lambda made: resolve(made["candidates"].select(*names)), "pivot": lambda made: pivot(made["resolved"])})

    q = spark.readStream.schema(schema).parquet(incoming).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return q
