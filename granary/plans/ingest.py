"""From pages, model answers and tables to stored statement metrics, all documents at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators import candidates as C
from granary.operators import grounding, pages, ratios, resolve, structure
from granary.package import written

#: Fewer grounded candidates than this send a document to its lines.
LEAST_CANDIDATES = 3


@dataclass
class Ingested:
    classes: DataFrame
    candidates: DataFrame
    rejected: DataFrame
    resolved: DataFrame
    pivot: DataFrame
    wide: DataFrame
    computed: DataFrame
    provenance: DataFrame


def retried(raw: DataFrame, selected: DataFrame, page_answers: DataFrame) -> DataFrame:
    """Answers for single pages (doc_id, page_no, raw_json) that count: those for the pages of cash flow
    statements that go over several pages and of which the answer for all together gave no candidate."""
    several = selected.filter("statement_type = 'cash_flow' and ord > 0").select("doc_id").distinct()
    silent = several.join(raw.filter("statement_type = 'cash_flow'").select("doc_id").distinct(), "doc_id", "left_anti")
    pages_of = selected.filter("statement_type = 'cash_flow'").select("doc_id", "page_no", "statement_type").join(silent, "doc_id")
    return page_answers.join(pages_of, ["doc_id", "page_no"])


def ingest(pages_df: DataFrame, answers: DataFrame, tables: DataFrame, page_answers: DataFrame | None = None) -> Ingested:
    """``pages_df`` (doc_id, page_no, text); ``answers`` (doc_id, statement_type, raw_json); ``tables`` (doc_id,
    page_no, table_id, ord, header, rows); ``page_answers`` (doc_id, page_no, raw_json), answers for single pages
    of cash flow statements, see ``retried``: each page is checked against itself alone, then pages are merged.
    Steps that several others read (classes, selected pages, tables of calls, checked and verified candidates) run here, once
    each, and are kept as tables; what follows them is lazy."""
    classes = written(pages.classify(pages_df), "ingest-classes")
    existing = pages_df.select("doc_id", "page_no").distinct()
    selected = written(pages.select_pages(classes).join(existing, ["doc_id", "page_no"]), "ingest-selected")
    sections = classes.select("doc_id", "page_no", "section_type")
    first = selected.filter("ord = 0").join(sections, ["doc_id", "page_no"])
    parsed = C.parse_answers(answers.join(first.select("doc_id", "statement_type", "page_no", "section_type"), ["doc_id", "statement_type"]))
    raw = C.from_answers(parsed).withColumn("call", F.col("statement_type"))
    calls = selected.withColumn("call", F.col("statement_type"))
    if page_answers is not None:
        alone = F.concat(F.lit("cash_flow/"), F.col("page_no").cast("string"))
        again = retried(raw, selected, page_answers).join(sections, ["doc_id", "page_no"])
        raw = raw.unionByName(C.from_answers(C.parse_answers(again)).withColumn("call", alone))
        calls = calls.unionByName(selected.filter("statement_type = 'cash_flow'").withColumn("call", alone))
    blocks = pages.page_blocks(calls.select("doc_id", F.col("call").alias("statement_type"), "ord", "page_no"), pages_df).withColumnRenamed("statement_type", "call")
    checked = written(grounding.validate(raw, blocks, "call"), "ingest-checked")
    called = structure.with_column_years(tables.join(calls.select("doc_id", "page_no", "call", F.col("ord").alias("_page")), ["doc_id", "page_no"]))
    called = written(called.withColumn("ord", F.col("_page") * 1000 + F.col("ord")), "ingest-tables")
    verified = written(structure.validate(grounding.accepted(checked), called), "ingest-verified")
    kept = structure.kept(verified)
    single = F.col("call") != F.col("statement_type")
    kept = kept.filter(~single).unionByName(C.merge_pages(kept.filter(single))).drop("call")

    enough = kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_CANDIDATES).select("doc_id")
    # Only the pages of these documents are read line by line.
    rest = pages_df.join(enough, "doc_id", "left_anti")
    lines = C.from_lines(rest, classes, pages.document_years(rest))
    for name, kind in (("verification_state", "string"), ("verification_reason", "string"), ("table_id", "string"), ("row_index", "int"), ("col_index", "int")):
        lines = lines.withColumn(name, F.lit(None).cast(kind))
    # Grounded candidates come first, as they are found first.
    everything = kept.withColumn("seq", F.struct(F.lit(0).alias("pass"), F.array_position(F.array(F.lit("balance_sheet"), F.lit("income_statement"), F.lit("cash_flow")), F.col("statement_type")).alias("call"), F.col("seq").alias("at")))
    everything = everything.unionByName(lines.withColumn("seq", F.struct(F.lit(1).alias("pass"), F.lit(0).cast("long").alias("call"), F.col("seq").alias("at"))))
    resolved = resolve.resolve(everything)
    wide = ratios.wide(resolved)
    lost = grounding.rejections(checked).select("doc_id", "statement_type", "metric_name", "raw_label", "value", "year", "rejection_reasons")
    contradicted = verified.filter("verification_state = 'REJECTED'").select("doc_id", "statement_type", "metric_name", "raw_label", "value", "year", F.concat(F.lit("l6_structural_contradiction: "), "verification_reason").alias("rejection_reasons"))
    return Ingested(classes, everything, lost.unionByName(contradicted), resolved, resolve.pivot(resolved), wide, ratios.compute(wide), ratios.provenance(wide))
