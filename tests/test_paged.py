"""The data source of page ranges."""

import pytest

from granary.sources.paged import PagedFiles, register


@pytest.fixture
def pages(spark, tmp_path):
    register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/long.txt").write_text("\f".join(f"page {i}" for i in range(1, 2001)))
    (tmp_path / "in/short.txt").write_text("alone")
    (tmp_path / "in/bad.txt").write_bytes(b"\xff\xfe\xfa")
    return lambda r, **o: r.format("paged_files").option("path", str(tmp_path / "in")).option("pattern", "*.txt").options(**o).load()


def test_a_long_file_is_many_tasks(spark, pages):
    got = pages(spark.read)
    assert got.rdd.getNumPartitions() == 42
    rows = {(r["path"].rsplit("/", 1)[1], r["page_no"]): r for r in got.collect()}
    assert len(rows) == 2002 and rows["long.txt", 1777]["text"] == "page 1777" and rows["bad.txt", None]["error"] and rows["short.txt", 1]["parser"] == "text"
    one = rows["short.txt", 1]["doc_id"]
    assert pages(spark.read).filter(f"doc_id = '{one}'").count() == 1


def test_filters_rule_out_ranges(spark, pages):
    some = pages(spark.read).filter("page_no between 990 and 1010 and page_no <> 1000")
    assert some.rdd.getNumPartitions() <= 3 and sorted(r["page_no"] for r in some.collect()) == [n for n in range(990, 1011) if n != 1000]


def test_the_chain_decides_per_range(spark, pages, tmp_path):
    """A parser that fails in one range leaves that range alone to the next."""
    from granary.sources.paged import PARSERS, PageParser

    def fails(body, first, last):
        if first == 101:
            raise ValueError("torn")
        return [f"fine {k}" for k in range(first, last + 1)]

    class Chained(PagedFiles):
        parsers = {"fine": PageParser(PARSERS["text"].count, fails), **PARSERS}

        @classmethod
        def name(cls):
            return "chained_files"

    register(spark, Chained)
    long = spark.read.format("chained_files").option("path", str(tmp_path / "in")).option("pattern", "long.txt").option("parsers", "fine,text").load()
    rows = {r["page_no"]: r for r in long.collect()}
    assert len(rows) == 2000 and {rows[n]["text"] for n in range(101, 151)} == {f"page {n}" for n in range(101, 151)} and rows[151]["text"] == "fine 151"


def test_a_stream_has_the_files_that_changed(spark, pages, tmp_path):
    import os

    def run():
        q = pages(spark.readStream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == 2002
    (tmp_path / "in/new.txt").write_text("one\ftwo")
    os.utime(tmp_path / "in/new.txt", (2_000_000_000, 2_000_000_000))
    assert run() == 2004 and run() == 2004
