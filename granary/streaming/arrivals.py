"""Pages and model answers that arrive by themselves: a stream-stream outer join, and the ingest of what it gives.

A document's pages raise one call per statement; an answer counts for its call if it comes within ``wait``. Both
sides carry watermarks, so the state of a call goes when no answer can come any more, and the call then leaves
without one, which sends its document to its lines. A document is ingested anew whenever calls of it leave, with
all answers it has so far, and its rows are replaced as one change; so what stands in the end is what the batch
ingest makes of the same pages and the answers that were in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary import registry as R
from granary.package import scratch
from granary.plans.ingest import ingest
from granary.sources import versions

#: Columns of arriving pages, answers and tables.
PAGES = "doc_id string, page_no int, text string, at timestamp"
ANSWERS = "doc_id string, statement_type string, raw_json string, at timestamp"
TABLES = "doc_id string, page_no int, table_id string, ord int, header array<string>, rows array<array<string>>"
WAIT, LATE = "30 minutes", "10 minutes"


def calls_of(pages: DataFrame, late: str = LATE) -> DataFrame:
    """doc_id, statement_type, asked_at: one call per document and statement, at its first page that comes."""
    statements = F.explode(F.array(*map(F.lit, R.STATEMENTS)))
    p = pages.filter("doc_id is not null and at is not null").withWatermark("at", late)
    return p.select("doc_id", F.col("at").alias("asked_at"), statements.alias("statement_type")).dropDuplicatesWithinWatermark(["doc_id", "statement_type"])


def answered(calls: DataFrame, answers: DataFrame, wait: str = WAIT) -> DataFrame:
    """Calls (doc_id, statement_type, asked_at, further columns) with each answer (answered_at, further columns) that came
    from when they were asked to ``wait`` later; a call without one has nulls, once none can come any more.
    Both carry watermarks on their times. Several answers of a call stay several rows."""
    a = answers.withColumnsRenamed({"doc_id": "_doc", "statement_type": "_statement"})
    meet = (F.col("doc_id") == F.col("_doc")) & (F.col("statement_type") == F.col("_statement"))
    in_time = (F.col("answered_at") >= F.col("asked_at")) & (F.col("answered_at") <= F.col("asked_at") + F.expr(f"INTERVAL {wait}"))
    return calls.join(a, meet & in_time, "leftOuter").drop("_doc", "_statement")


def ingest_arrivals(spark: SparkSession, incoming: str, folder: str, checkpoint: str, wait: str = WAIT, late: str = LATE) -> None:
    """Takes what has arrived under ``incoming``/pages, /answers and /tables (Parquet) since the last call into the
    versioned store ``folder``: tables pages, answers, resolved. Pages are kept first; of a document
    that is sent again within a call all pages count together, later ones replace it. Repeating a batch
    changes nothing: answers are keyed by batch."""

    def keep(batch: DataFrame, number: int) -> None:
        versions.replace(spark, folder, {"pages": batch.select("doc_id", "page_no", "text").filter("doc_id is not null")})

    def take(batch: DataFrame, number: int) -> None:
        new = batch.select("doc_id", "statement_type", "raw_json", F.lit(number).alias("batch")).persist()
        try:
            if not new.isEmpty():
                replace(new, number)
        finally:
            new.unpersist()

    def replace(new: DataFrame, number: int) -> None:
        named = new.select("doc_id").distinct()
        before = versions.read(spark, folder, "answers")
        known = new if before is None else new.unionByName(before.filter(F.col("batch") != number).join(named, "doc_id", "left_semi"))
        tables = spark.read.schema(TABLES).parquet(f"{incoming}/tables").join(named, "doc_id", "left_semi")

        def resolved(written: dict[str, DataFrame]) -> DataFrame:
            answers = written["answers"]
            mine = versions.read(spark, folder, "pages").join(answers.select("doc_id").distinct(), "doc_id", "left_semi")
            return ingest(mine, answers.filter("raw_json is not null").select("doc_id", "statement_type", "raw_json"), tables).resolved

        with scratch(spark):
            versions.replace(spark, folder, {"answers": known, "resolved": resolved}, named)

    def run(stream: DataFrame, step, name: str) -> None:
        stream.writeStream.outputMode("append").option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).foreachBatch(step).start().awaitTermination()

    read = lambda name, kind: spark.readStream.schema(kind).parquet(f"{incoming}/{name}")
    run(read("pages", PAGES), keep, "pages")
    answers = read("answers", ANSWERS).withColumnRenamed("at", "answered_at").withWatermark("answered_at", late)
    run(answered(calls_of(read("pages", PAGES), late), answers, wait), take, "calls")
