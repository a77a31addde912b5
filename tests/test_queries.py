import pytest

from comparing import agree
from granary.oracles import SQL
from granary.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert agree(QUERIES[name](spark, SF), SF, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    frame = QUERIES[name](spark, SF)
    assert frame.columns and frame.count() >= 0


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_one_aggregation_feeds_ratios_and_risks(spark):
    """Ratios, risks and growth are projections and one window over one wide aggregation."""
    plan = QUERIES["risks"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "ReadSchema" in plan and "l_comment" not in plan


@pytest.mark.parametrize("name", ["answered_calls", "conversation_rows", "stream_windows"])
def test_streams_read_folders_of_files(spark, tmp_path, name):
    for t in ("conversations", "events", "lineitem", "orders"):
        spark.read.parquet(f"{SF}/{t}.parquet").repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
    found = QUERIES[name](spark, str(tmp_path))
    assert agree(found, SF, SQL[name])


def test_ranks_are_one_number_in_the_sort(spark):
    """What is sorted where candidates are read spills: no column of its own for each part of the rank."""
    from granary import bind
    from granary.operators import resolve

    plan = resolve.best_candidates(bind.candidates(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "_order" in plan and "_w0" not in plan and "_w1" not in plan


def test_ingest_makes_each_step_once(spark):
    """Steps that several others read are tables: the rest of the plan has few leaves, and none is the printing of pages."""
    plan = QUERIES["ingest"](spark, SF)._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() <= 16 and "l_orderkey" not in plan.toString()


def test_scratch_tables_go_at_the_end(spark):
    from pathlib import Path

    from granary.package import scratch, shared_dir, written

    with scratch(spark):
        made = written(spark.range(5), "trial")
        at = Path(made.inputFiles()[0].removeprefix("file://")).parent
        assert made.count() == 5 and at.exists() and shared_dir(spark).removeprefix("file://") in str(at)
    assert not at.exists()


@pytest.mark.parametrize("name", ["explain", "mentions", "prompts"])
def test_resolved_rows_are_made_once(spark, name):
    """Queries that read resolved rows several times read them from a table: candidates are read and sorted once."""
    assert "l_orderkey" not in QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["risks", "ratio_states", "computed_units", "missing_warning"])
def test_unread_columns_are_not_carried(spark, name):
    """What a query doesn't read of resolved rows is neither read from lineitem nor aggregated."""
    lines = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    plan = "\n".join(line for line in lines if "Relation" not in line)
    assert ("l_quantity" in plan) == (name == "ratio_states") and "order " not in plan and "derived(" not in plan
    assert ("INR" in plan) == (name == "computed_units")


@pytest.mark.parametrize("name", ["metrics_view", "metric_lines", "risk_view", "risks", "provenance", "ratio_warnings"])
def test_ranked_rows_are_those_of_lineitem(spark, name):
    """The sort in front of the first shuffle holds lineitem's own columns; text is made for the rows that stay."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    ranked = [line for line in plan.splitlines() if "WindowGroupLimit" in line and "Partial" in line]
    assert ranked and all("[l_suppkey" in line and "doc_id" not in line and "metric_name" not in line for line in ranked)


def test_view_gives_the_same_candidates(spark, tmp_path):
    """Rows ranked first and read as candidates then are those that rank as candidates, with ties, nulls and lone totals."""
    from pyspark.sql import functions as F

    from granary import bind
    from granary.operators import resolve

    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    nulls = lambda k, *cs: {c: F.when(F.col("l_orderkey") % k != 0, F.col(c)) for c in cs}
    odd = li.withColumns(nulls(3, "l_returnflag", "l_suppkey") | nulls(4, "l_linestatus", "l_tax", "l_discount") | nulls(5, "l_extendedprice", "l_quantity") | nulls(7, "l_partkey") | nulls(11, "l_shipdate"))
    same = li.withColumns({"l_orderkey": F.lit(1).cast("long"), "l_linenumber": F.lit(3), "l_extendedprice": F.col("l_extendedprice") % 3})
    li.unionByName(odd).unionByName(same).write.parquet(f"{tmp_path}/lineitem.parquet")
    told = lambda frame: sorted(map(repr, frame.select(resolve.CONTRACT).collect()))
    want = told(resolve.resolve(bind.candidates(spark, str(tmp_path))))
    assert len(want) > 1000 and told(resolve.resolve(*bind.candidate_rows(spark, str(tmp_path)))) == want


@pytest.mark.parametrize("name", ["risk_view", "ratio_view"])
def test_states_come_with_the_ratios(spark, name):
    """Ratios and their trust states are read from the same wide rows: lineitem is read once, and no join follows."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() == 1 and "Join" not in plan.toString()


@pytest.mark.parametrize("name", ["risk_view", "ratio_view"])
def test_rows_without_a_document_are_as_in_sql(spark, tmp_path, name):
    from pathlib import Path

    import duckdb

    for f in Path(SF).iterdir():
        if f.name != "lineitem.parquet":
            (tmp_path / f.name).symlink_to(f)
    duckdb.sql(f"COPY (SELECT * REPLACE (CASE WHEN l_suppkey % 4 > 0 THEN l_suppkey END AS l_suppkey) FROM '{SF}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    assert agree(QUERIES[name](spark, str(tmp_path)), str(tmp_path), SQL[name])
