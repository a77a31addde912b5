"""Registered queries against SQL, and the pipeline's stages."""

import pytest

from comparing import agree
from granary.llm.queries import ORACLES, QUERIES
from granary.llm.shared import tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert agree(QUERIES[name](spark, SF), SF, ORACLES[name])


def test_native_plans(spark):
    for name in ("op1_mix", "op5_line_dedup"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


def test_stages(spark):
    import corpus_pipeline as p

    docs = tables(spark, SF, "documents")
    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]
    given = {r["doc_id"] for r in docs.collect()}
    from granary.llm.shared import written

    for i, (name, stage) in enumerate(p.STAGES):
        out = written(stage(spark, docs, SF), name)
        if i < 4:
            assert out.columns == docs.columns and {r["doc_id"] for r in out.select("doc_id").collect()} <= given
            docs = out
        if name == "language_id":
            assert out.count() == tables(spark, SF, "documents").count()
        if name == "near_dedup":
            assert out.count() == out.select("doc_id").distinct().count()
    assert out.groupBy("sequence_id").sum("length").filter("`sum(length)` > 4096").count() == 0


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as p

    from test_llm_operators import odd

    odd(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() > 0


def test_very_long_texts(spark, tmp_path):
    """Every query on texts and the pipeline over a text of 200,000 lines and one of 2 million words."""
    import corpus_pipeline as p

    texts = ["\n".join(f"line {i % 150000} of a log" for i in range(200_000)), " ".join(f"word{i % 90000}" for i in range(2_000_000)), *[f"some short words {i} and others" for i in range(40)]]
    rows = [(i, t, "en" if i % 4 else "de", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(42)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op1_mix", "op4_near_dedup", "op5_line_dedup", "op6_toxicity", "op7_language", "op8_secrets", "op9_lm_score"):
        assert QUERIES[name](spark, str(tmp_path)).filter("doc_id is not null").count() == 42, name
    for run in (QUERIES["op2_pack"], p.run):
        pieces = run(spark, str(tmp_path))
        assert pieces.groupBy("doc_id", "doc_tokens").sum("length").filter("`sum(length)` % doc_tokens <> 0").count() == 0
        assert pieces.groupBy("sequence_id").sum("length").filter("`sum(length)` > 4096").count() == 0
