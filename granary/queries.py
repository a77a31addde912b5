"""Registered queries of the statement operators, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary import bind
from granary.functions import text as T
from granary.operators import candidates as C
from granary.operators import chunks, evaluate, extraction_prompts, grounding, pages, prompts, ratios, resolve, structure, views
from granary.package import shared_dir, written
from granary.plans import ingest
from granary.streaming import arrivals, conversations, refresh

Query = Callable[[SparkSession, str], DataFrame]


def _resolved(s: SparkSession, d: str) -> DataFrame:
    return resolve.resolve(*bind.candidate_rows(s, d))


def _kept(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """Resolved rows as a table, of those columns that are read, for queries that read them several times."""
    return written(_resolved(s, d).select("doc_id", "metric_name", "year", "value", "section_type", *columns), "resolved")


def _wide(s: SparkSession, d: str) -> DataFrame:
    return ratios.wide(_resolved(s, d))


def _computed(s: SparkSession, d: str) -> DataFrame:
    return ratios.compute(_wide(s, d))


def _listed(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


RATIO_COLUMNS = ["total_debt", *[r[0] for r in ratios.R.RATIOS], *[g[0] for g in ratios.R.GROWTH]]
RISK_COLUMNS = [*[r[0] for r in ratios.R.RISKS], "overall_risk"]


def valid_years(s: SparkSession, d: str) -> DataFrame:
    c = bind.table(s, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("doc_id"), F.year("l_shipdate").alias("year"))
    return resolve.valid_years(c).groupBy("doc_id", "year").agg(F.count(F.lit(1)).alias("n"))


def resolved(s: SparkSession, d: str) -> DataFrame:
    return _resolved(s, d).drop("verification_reason", "table_id", "row_index", "col_index")


def derived_totals(s: SparkSession, d: str) -> DataFrame:
    return resolve.derived_totals(resolve.best_candidates(*bind.candidate_rows(s, d))).select("doc_id", "year", "metric_name", "value", "raw_label", "page_no", "verification_state")


def provenance(s: SparkSession, d: str) -> DataFrame:
    return ratios.provenance(_wide(s, d)).drop("seq").withColumn("source_pages", _listed("source_pages"))


def ratio_warnings(s: SparkSession, d: str) -> DataFrame:
    return ratios.warnings(_wide(s, d)).drop("seq")


def missing_core(s: SparkSession, d: str) -> DataFrame:
    return resolve.missing_core(resolve.pivot(_resolved(s, d))).withColumn("missing", _listed("missing"))


def quality(s: SparkSession, d: str) -> DataFrame:
    q = resolve.quality(bind.candidates(s, d), _resolved(s, d), bind.document_rows(s, d))
    missing = F.array_join(F.transform(F.array_sort(F.map_entries("missing")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return q.select("doc_id", "candidate_rows", "resolved_rows", missing.alias("missing"), F.array_join("issues", "|").alias("issues"))


def explain(s: SparkSession, d: str) -> DataFrame:
    r = _kept(s, d, "unit", "page_no", "raw_label", "evidence", "verification_state", "table_id", "row_index", "col_index")
    e = views.explain(ratios.wide(r), r)
    side = lambda x: [F.col(f"{x}_row.{c}").alias(f"{x}_{c}") for c in ("unit", "page_no", "raw_label", "evidence", "verification_state", "table_id", "row_index", "col_index")]
    named = ["formula_str", "numerator", "denominator", "numerator_val", "denominator_val", "scope_warning", "state", _listed("source_pages"), "risk_type", "risk_level", "threshold"]
    return e.select("doc_id", "year", "ratio_name", "result", *named, *side("numerator"), *side("denominator"))


def gold_scores(s: SparkSession, d: str) -> DataFrame:
    return evaluate.gold_scores(bind.gold(s, d), _resolved(s, d))


def merge_pages(s: SparkSession, d: str) -> DataFrame:
    return C.merge_pages(bind.candidates(s, d)).select("doc_id", "metric_name", "year", "value", "verification_state")


def answered_pairs(s: SparkSession, d: str) -> DataFrame:
    return views.answered_pairs(bind.table(s, d, "conversations")).select("conv_id", "turn", "role", "text")


def top_k(s: SparkSession, d: str) -> DataFrame:
    """Every row whose id is divisible by 50 against all rows of its label."""
    v = bind.table(s, d, "embeddings")
    q = v.filter("vec_id % 50 = 0").select("label", F.col("vec_id").alias("query_id"), "embedding")
    return chunks.top_k(v, q, 4, "label").withColumn("score", F.round("score", 9))


def top_k_search(s: SparkSession, d: str) -> DataFrame:
    """As top_k, over an index that is stored first."""
    v = bind.table(s, d, "embeddings")
    name = f"granary_index_{uuid.uuid4().hex}"
    chunks.store_index(v, name, "label", buckets=16)
    q = v.filter("vec_id % 50 = 0").select("label", F.col("vec_id").alias("query_id"), "embedding")
    return chunks.search_index(q, name, 4, "label").withColumn("score", F.round("score", 9))


def content_gate(s: SparkSession, d: str) -> DataFrame:
    return pages.content_gate(bind.web_pages(s, d), ["table", "footer"])


def page_offsets(s: SparkSession, d: str) -> DataFrame:
    return chunks.offsets(bind.text_pages(s, d)).select("doc_id", "page_no", "char_start", "char_end")


def parse_values(s: SparkSession, d: str) -> DataFrame:
    return bind.printed_values(s, d).withColumn("value", T.parse_value(F.col("raw"))).drop("raw")


def header_years(s: SparkSession, d: str) -> DataFrame:
    return bind.headers(s, d).select("o_orderkey", T.header_years(F.col("header")).alias("years")).withColumn("years", _listed("years"))


def column_years(s: SparkSession, d: str) -> DataFrame:
    return bind.headers(s, d).select("o_orderkey", T.column_years(F.col("header")).alias("years")).withColumn("years", _listed("years"))


def match_labels(s: SparkSession, d: str) -> DataFrame:
    c = bind.candidates(s, d).select("raw_label", "statement_type").distinct()
    return c.select("raw_label", "statement_type", T.match_metric(F.col("raw_label"), F.col("statement_type")).alias("metric_name"))


def text_scan(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return bind.table(s, d, "documents").select("doc_id", F.regexp_count(t, F.lit("[0-9]")).cast("long").alias("digits"), F.length(t).cast("long").alias("chars"), T.section_hint(t).alias("hint"))


def classify_pages(s: SparkSession, d: str) -> DataFrame:
    return pages.classify(bind.text_pages(s, d))


def select_pages(s: SparkSession, d: str) -> DataFrame:
    return pages.select_pages(_classes(s, d))


def chunk_pages(s: SparkSession, d: str) -> DataFrame:
    p = bind.text_pages(s, d)
    return chunks.chunk(p, pages.classify(p).select("doc_id", "page_no", "statement_type"))


def metric_lines(s: SparkSession, d: str) -> DataFrame:
    return prompts.resolved_section(_resolved(s, d))


def prompt_texts(s: SparkSession, d: str) -> DataFrame:
    r = _kept(s, d, "unit", "page_no", "verification_state", "verification_reason")
    w = ratios.wide(r)
    q = bind.questions(s, d).filter("role = 'user'").select("query_id", "doc_id", "question")
    found = bind.retrieved(s, d).withColumn("query_id", F.concat_ws("/", F.col("query_id").cast("string"), F.lit("0")))
    return prompts.prompts(q, prompts.resolved_section(r), prompts.computed_section(w), prompts.documents_section(found))


def mentions(s: SparkSession, d: str) -> DataFrame:
    r = _kept(s, d, "unit", "page_no", "verification_state")
    q = bind.questions(s, d).select("query_id", "doc_id", "question", "answer")
    return views.mentions(q, ratios.compute(ratios.wide(r)), r)


def stream_windows(s: SparkSession, d: str) -> DataFrame:
    at = f"{shared_dir(s)}/granary/stream-{uuid.uuid4().hex}"
    refresh.drained(refresh.windowed_counts(bind.stream(s, d, "events")), f"{at}/out", f"{at}/state")
    return refresh.latest(s, f"{at}/out", ["start", "event_type"], ["n"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


def answered_calls(s: SparkSession, d: str) -> DataFrame:
    """Calls and answers as two streams, joined as they arrive; calls without an answer in time leave alone."""
    at = f"{shared_dir(s)}/granary/calls-{uuid.uuid4().hex}"
    calls = bind.asked_calls(bind.stream(s, d, "orders")).withWatermark("asked_at", "30 days")
    answers = bind.given_answers(bind.stream(s, d, "lineitem")).withWatermark("answered_at", "30 days")
    joined = arrivals.answered(calls, answers, "1452 hours").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("asked_at", "answered_at")})
    refresh.drained(joined, f"{at}/out", f"{at}/state", "append")
    return s.read.schema(joined.schema).parquet(f"{at}/out").drop("batch")


def conversation_rows(s: SparkSession, d: str) -> DataFrame:
    """Chat sessions made from conversations, run as a stream with keyed state."""
    at = f"{shared_dir(s)}/granary/chat-{uuid.uuid4().hex}"
    refresh.drained(conversations.conversation_rows(bind.chat_events(bind.stream(s, d, "conversations"))), f"{at}/out", f"{at}/state", "append")
    out = s.read.schema(f"{conversations.ROWS}, batch int").parquet(f"{at}/out")
    told = F.array_join(F.transform("history", lambda m: F.concat_ws(":", m["role"], m["text"])), "|")
    return out.select("session", "seq", "outcome", "generation", "messages", F.size("history").alias("told"), F.md5(told.cast("binary")).alias("history"))


def _classes(s: SparkSession, d: str) -> DataFrame:
    return pages.classify(bind.statement_pages(s, d))


def _blocks(s: SparkSession, d: str) -> DataFrame:
    return pages.page_blocks(pages.select_pages(_classes(s, d)), bind.statement_pages(s, d))


CANDIDATE_COLUMNS = ["doc_id", "page_no", "statement_type", "metric_name", "raw_label", "value", "year", "unit", "section_type", "confidence", "seq"]


def narrative_pages(s: SparkSession, d: str) -> DataFrame:
    return chunks.narrative(bind.statement_pages(s, d), _classes(s, d)).drop("text")


def tagged_tables(s: SparkSession, d: str) -> DataFrame:
    return pages.tag_tables(bind.statement_tables(s, d), _classes(s, d)).select("doc_id", "page_no", "statement_type", "section_hint")


def line_candidates(s: SparkSession, d: str) -> DataFrame:
    p = bind.statement_pages(s, d)
    return C.from_lines(p, pages.classify(p), pages.document_years(p)).select(CANDIDATE_COLUMNS)


def table_candidates(s: SparkSession, d: str) -> DataFrame:
    t = bind.statement_tables(s, d)
    t = t.withColumn("rows", F.concat(F.array("header"), "rows")).withColumn("table_id", F.col("ord").cast("string"))
    return C.from_tables(t, _classes(s, d)).select(CANDIDATE_COLUMNS)


def answer_candidates(s: SparkSession, d: str) -> DataFrame:
    return C.from_answers(C.parse_answers(bind.model_answers(s, d))).select(*CANDIDATE_COLUMNS, "evidence")


def grounded(s: SparkSession, d: str) -> DataFrame:
    v = grounding.validate(bind.claims(s, d), _blocks(s, d))
    return v.select("doc_id", "page_no", "pos", "l2_passed", "l3_passed", "l4_passed", "l5_passed", "l5_degraded", F.array_join("rejection_reasons", "; ").alias("rejection_reasons"))


def _structural_tables(s: SparkSession, d: str) -> DataFrame:
    t = structure.from_extracted(bind.statement_tables(s, d))
    return t.withColumn("call", F.element_at(F.array(*[F.lit(p[0]) for p in bind.STATEMENT_PAGES]), F.col("page_no")))


def table_cells(s: SparkSession, d: str) -> DataFrame:
    c = structure.table_cells(_structural_tables(s, d)).filter("col_index > 0")
    return c.select("doc_id", "call", "row_index", "col_index", "cell_value", F.get("years", F.lit(0)).alias("year"))


def structural(s: SparkSession, d: str) -> DataFrame:
    v = structure.validate(bind.cell_claims(s, d), _structural_tables(s, d))
    return v.select("doc_id", "call", "seq", "verification_state", "verification_reason", "table_id", "row_index", "col_index")


def metrics_view(s: SparkSession, d: str) -> DataFrame:
    v = views.metrics_view(bind.document_rows(s, d), _resolved(s, d))
    named = F.transform("metrics", lambda m: F.concat_ws(":", m["year"].cast("string"), m["metric_name"], T.printed(m["value"], 2), m["unit"], m["page_no"].cast("string"), m["raw_label"], m["section_type"], m["confidence"], m["evidence"], m["verification_state"]))
    return v.select("doc_id", "company_name", _listed("document_years"), F.size("metrics").cast("long").alias("n"), F.array_join(F.array_sort(named), ",").alias("metrics"))


def ratio_view(s: SparkSession, d: str) -> DataFrame:
    states = F.array_join(F.transform(F.array_sort(F.map_entries("states")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("-")))), ",")
    return views.ratio_view(_wide(s, d)).withColumn("states", states)


def metric_at(s: SparkSession, d: str) -> DataFrame:
    wanted = bind.candidates(s, d).select("doc_id", "metric_name", (F.col("year") + 1).alias("year"))
    return views.metric_at(_resolved(s, d), wanted)


def document_guard(s: SparkSession, d: str) -> DataFrame:
    asked = bind.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"))
    return views.document_guard(asked, bind.document_rows(s, d))


def sources(s: SparkSession, d: str) -> DataFrame:
    p = chunks.sources(bind.retrieved(s, d)).select("query_id", F.posexplode("pages").alias("place", "p"))
    return p.select("query_id", "p.page_no", (F.col("place") + 1).alias("place"), F.array_join("p.sections", ",").alias("sections"), F.size("p.snippets").alias("snippets"))


def chunk_locations(s: SparkSession, d: str) -> DataFrame:
    """Where chunks of 25 characters stand in the narrative pages."""
    placed = chunks.offsets(chunks.narrative(bind.statement_pages(s, d).filter("page_no > 3"), _classes(s, d)))
    n = placed.groupBy("doc_id").agg(F.max("char_end").alias("n"))
    parts = n.select("doc_id", F.posexplode(F.sequence(F.lit(0), F.col("n"), F.lit(25))).alias("i", "char_start"))
    parts = parts.select("doc_id", "i", F.lit("x").alias("text"), "char_start", (F.col("char_start") + 25).alias("char_end"))
    return chunks.locate(parts, placed, chunks.headings(placed)).drop("text")


def ingested(s: SparkSession, d: str) -> DataFrame:
    """Resolved metrics of the printed statements, from pages, model answers and tables; pages are printed once."""
    answers = bind.model_answers(s, d).select("doc_id", "statement_type", "raw_json")
    tables = structure.from_extracted(bind.statement_tables(s, d))
    return ingest.ingest(written(bind.statement_pages(s, d), "ingest-pages"), answers, tables).resolved


def scope_tags(s: SparkSession, d: str) -> DataFrame:
    return _resolved(s, d).select("doc_id", "metric_name", "year", prompts.scope_tag(F.col("section_type")).alias("scope"), T.title_case(F.col("metric_name")).alias("title"))


def text_forms(s: SparkSession, d: str) -> DataFrame:
    """Lines of all documents: how many are headings, and a digest of each kind of key."""
    t = bind.table(s, d, "documents")
    line = t.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).filter(F.length(F.trim("line")) > 0)
    k = structure.row_key(F.col("line"))
    f = line.select("doc_id", T.heading_shaped(F.col("line")).alias("h"), k.alias("k"), T.grounding_key(F.col("line")).alias("g"), T.line_label(F.col("line")).alias("l"))
    told = lambda c: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.col(c).alias("v")))), lambda x: x["v"]), "|").cast("binary"))
    return f.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("h").alias("headings"), told("k").alias("row_keys"), told("g").alias("grounding_keys"), told("l").alias("labels"))


QUERIES: dict[str, Query] = {
    "valid_years": valid_years, "resolve": resolved, "derived_totals": derived_totals, "pivot": lambda s, d: resolve.pivot(_resolved(s, d)),
    "ratios": lambda s, d: _computed(s, d).select("doc_id", "year", *RATIO_COLUMNS), "risks": lambda s, d: _computed(s, d).select("doc_id", "year", *RISK_COLUMNS),
    "provenance": provenance, "ratio_warnings": ratio_warnings, "missing_core": missing_core,
    "accounting_checks": lambda s, d: resolve.accounting_checks(resolve.pivot(_resolved(s, d))), "quality": quality,
    "ratio_states": lambda s, d: ratios.ratio_states(ratios.provenance(_wide(s, d))), "risk_view": lambda s, d: views.risk_view(_wide(s, d)), "explain": explain,
    "trust_summary": lambda s, d: views.trust_summary(_resolved(s, d)), "missing_warning": lambda s, d: views.missing_warning(_computed(s, d)),
    "computed_units": lambda s, d: ratios.computed_units(_wide(s, d)), "gold_scores": gold_scores, "coverage": lambda s, d: evaluate.coverage(bind.candidates(s, d), bind.call_stats(s, d)),
    "merge_pages": merge_pages, "answered_pairs": answered_pairs, "top_k": top_k, "top_k_search": top_k_search, "content_gate": content_gate,
    "upload_gates": lambda s, d: views.upload_gates(bind.uploads(s, d)), "page_offsets": page_offsets, "parse_values": parse_values,
    "header_years": header_years, "column_years": column_years, "match_labels": match_labels, "text_scan": text_scan, "stream_windows": stream_windows, "conversation_rows": conversation_rows, "answered_calls": answered_calls,
    "classify_pages": classify_pages, "select_pages": select_pages, "chunk_pages": chunk_pages, "metric_lines": metric_lines, "mentions": mentions, "prompts": prompt_texts,
    "statement_classes": _classes, "statement_selection": select_pages, "statement_blocks": _blocks, "extraction_prompts": lambda s, d: extraction_prompts.extraction_prompts(_blocks(s, d)),
    "header_page_years": lambda s, d: pages.document_years(bind.statement_pages(s, d)).withColumn("years", _listed("years")), "company_names": lambda s, d: pages.company_names(bind.statement_pages(s, d)),
    "narrative_pages": narrative_pages, "tagged_tables": tagged_tables, "line_candidates": line_candidates, "table_candidates": table_candidates, "answer_candidates": answer_candidates, "grounded": grounded,
    "table_cells": table_cells, "structural": structural, "metrics_view": metrics_view, "ratio_view": ratio_view, "metric_at": metric_at, "years_of": lambda s, d: views.years_of(_resolved(s, d)).withColumn("years", _listed("years")),
    "document_guard": document_guard, "sources": sources, "scope_tags": scope_tags, "text_forms": text_forms, "chunk_locations": chunk_locations, "ingest": ingested,
}
