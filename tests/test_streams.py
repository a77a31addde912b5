"""Streams over several batches, with restarts in between."""

from pyspark.sql import functions as F

from granary.sources import versions
from granary.streaming import arrivals, conversations, refresh


def chat(spark, tmp_path, batches, name):
    """Rows after all batches, each run by a query of its own on the same checkpoint."""
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "session long, s long, seq long, kind string, request long, text string")
        frame.select("session", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("at"), "seq", "kind", "request", "text").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
        events = spark.readStream.schema(conversations.EVENTS).parquet(f"{tmp_path}/{name}/in")
        for _ in range(1 + (i == 0)):  # a query that finds nothing new adds nothing
            refresh.drained(conversations.conversation_rows(events, idle=1000), f"{tmp_path}/{name}/out", f"{tmp_path}/{name}/state", "append")
    return sorted((r["session"], r["seq"], r["outcome"], r["generation"], r["messages"], tuple(m["text"] for m in r["history"] or [])) for r in spark.read.parquet(f"{tmp_path}/{name}/out").collect())


def test_conversations_drop_stale_replies(spark, tmp_path):
    e = [
        (1, 0, 1, "ask", 1, " first "), (1, 10, 2, "ask", 2, "too early"), (1, 20, 3, "reply", 1, "answer"), (1, 30, 4, "ask", 3, "second"), (1, 40, 5, "reset", None, None), (1, 50, 6, "reply", 3, "late"),
        (1, 60, 7, "ask", 4, "   "), (1, 70, 8, "ask", 5, "third"), (1, 80, 9, "fail", 5, "down"), (1, 90, 10, "retry", 6, None), (1, 100, 11, "reply", 5, "late"), (1, 110, 12, "reply", 6, "fine"),
        (1, 115, 13, "retry", 7, None), (1, 120, 14, "ask", 8, "fourth"), (2, 0, 1, "ask", 1, "alone"), (2, 5000, 2, "reply", 1, "hours later"), (3, 6000, 1, "reset", None, None),
    ]
    want = sorted([
        (1, 1, "asked", 0, 1, ()), (1, 2, "ignored", 0, 1, ()), (1, 3, "answered", 0, 2, ()), (1, 4, "asked", 0, 3, ("first", "answer")), (1, 5, "reset", 1, 0, ()), (1, 6, "stale", 1, 0, ()), (1, 7, "ignored", 1, 0, ()),
        (1, 8, "asked", 1, 1, ()), (1, 9, "failed", 1, 2, ()), (1, 10, "asked", 1, 1, ()), (1, 11, "stale", 1, 1, ()), (1, 12, "answered", 1, 2, ()), (1, 13, "ignored", 1, 2, ()), (1, 14, "asked", 1, 3, ("third", "fine")),
        (1, 14, "expired", 1, 3, ()), (2, 1, "asked", 0, 1, ()), (2, 1, "expired", 0, 1, ()), (2, 2, "stale", 0, 0, ()), (3, 1, "reset", 1, 0, ()),
    ])
    assert chat(spark, tmp_path, [e], "once") == want
    e.sort(key=lambda r: (r[1], r[0]))
    assert chat(spark, tmp_path, [e[:6], e[6:13], e[13:]], "often") == want


def test_arrivals_end_as_the_batch(spark, tmp_path, monkeypatch):
    """Answers in time, late, and none; then the same documents all at once. What is made of pages and answers is
    told here by a plain join, as the ingest has tests of its own."""

    class Made:
        def __init__(self, pages, answers, tables):
            self.resolved = pages.select("doc_id", "page_no").join(answers, "doc_id", "left")

    monkeypatch.setattr(arrivals, "ingest", Made)
    at = lambda minute: F.timestamp_seconds(F.lit(1_700_000_000 + 60 * minute))
    put = lambda frame, name: frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{name}")
    pages = {d: spark.createDataFrame([(d, 1, "text"), (d, 2, "more")], "doc_id string, page_no int, text string") for d in ("timely", "late", "silent", "mark")}
    answers = lambda d: spark.createDataFrame([(d, "balance_sheet", "{}")], "doc_id string, statement_type string, raw_json string")
    tables = spark.createDataFrame([], arrivals.TABLES)
    put(tables, "tables")
    for d in ("timely", "late", "silent"):
        put(pages[d].withColumn("at", at(0)), "pages")
    put(answers("timely").withColumn("at", at(20)), "answers")
    go = lambda: arrivals.ingest_arrivals(spark, f"{tmp_path}/in", f"{tmp_path}/store", f"{tmp_path}/state")
    go()
    put(answers("late").withColumn("at", at(31)), "answers")
    put(pages["mark"].withColumn("at", at(300)), "pages")
    put(answers("mark").withColumn("at", at(300)), "answers")
    go()
    got = versions.read(spark, f"{tmp_path}/store", "resolved").filter("doc_id <> 'mark'")
    want = Made(pages["timely"].unionByName(pages["late"]).unionByName(pages["silent"]), answers("timely"), tables).resolved
    rows = lambda frame: sorted(map(repr, (tuple(r) for r in frame.select(sorted(want.columns)).collect())))
    assert rows(got) == rows(want) and len(rows(got)) == 6


def test_conversations_need_no_package_beside_the_worker(tmp_path):
    """A session started elsewhere: neither the working folder nor PYTHONPATH names the package."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from pyspark.sql import SparkSession
from granary.queries import QUERIES
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").getOrCreate()
print("rows", QUERIES["conversation_rows"](s, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert run.stdout.startswith("rows ") and int(run.stdout.split()[1]) > 0, run.stderr[-2000:]
