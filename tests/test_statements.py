"""Statement operators on small fixtures: scenarios with known outcomes and the quirks that are kept."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary import registry as R
from granary.functions import text as T
from granary.operators import candidates as C
from granary.operators import chunks, extraction_prompts, grounding, pages, prompts, ratios, resolve, structure, views
from granary.plans.ingest import ingest
from granary.sources import documents, versions

CAND = "doc_id string, metric_name string, raw_label string, value double, unit string, year int, page_no int, statement_type string, section_type string, confidence string, source string, evidence string, verification_state string, verification_reason string, table_id string, row_index int, col_index int, seq long"


def cand(metric, value, year=2024, section="unknown", label=None, confidence="high", source="llm_extraction", state=None, page=1, seq=0, doc="d", unit="crore"):
    return (doc, metric, label or metric.replace("_", " "), float(value), unit, year, page, R.STATEMENT_OF[metric], section, confidence, source, "", state, None, None, None, None, seq)


def computed(spark, rows):
    return ratios.wide(resolve.resolve(spark.createDataFrame(rows, CAND)))


def one(frame):
    return frame.collect()[0].asDict(recursive=True)


def each(spark, values, f):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in frame.select(f(F.col("v")).alias("r"), "i").orderBy("i").select("r").collect()]


def test_values(spark):
    given = ["1,89,483", "(4,521)", "42.5", "–", "nil", "₹ 12", "Rs. 7", "(-5)", "−3", "12a", "", None, "5.", "  8 "]
    assert each(spark, given, T.parse_value) == [189483.0, -4521.0, 42.5, None, None, 12.0, 7.0, 5.0, -3.0, None, None, None, None, 8.0]


def test_labels(spark):
    given = ["(1) Revenue from operations", "Net Cash generated from Financing Activities (C)", "Net Cash Flow from Operating Activities *", "Total  current\nassets", "Revenue margin", "", "Borrowings", "Other current assets", "(A) *"]
    assert each(spark, given, T.match_metric) == ["revenue", "financing_cash_flow", "operating_cash_flow", "current_assets", None, None, "long_term_debt", None, None]


@pytest.mark.parametrize(("header", "years"), [
    ("Year ended\nMarch 31, 2025", [2025]), ("As at 31 March 2024 and as at 31 March 2023", [2024, 2023]), ("2023-24", [2024]), ("2023-2024", [2023, 2024]),
    ("2023-24 and 2025", [2024, 2025]), ("FY2024, 31 March 2024, 2024", [2024]), ("", []),
])
def test_column_years(spark, header, years):
    assert each(spark, [header], T.column_years) == [years]


def test_candidate_years_take_a_range_by_its_start(spark):
    assert each(spark, ["2023-24", "March 2024, FY 2023", "31 1999 2101"], T.header_years) == [[2023], [2024, 2023], []]


def test_lines_headings_sections(spark):
    assert each(spark, ["a\nb\r\nc\n", "", "x\x0cy", "a\n\nb"], T.lines) == [["a", "b", "c"], [], ["x", "y"], ["a", "", "b"]]
    assert each(spark, ["Balance Sheet", "balance sheet", "Total 1,234.00 5,678.00", "NOTES", ""], T.heading_shaped) == [True, False, False, True, False]
    assert each(spark, ["Consolidated\nStandalone", "x\ny\nz\nstandalone"], T.section_type) == ["consolidated", "unknown"]
    assert each(spark, ["Consolidated standalone"], T.section_hint) == ["unknown"]


FULL = [("revenue", 2000), ("gross_profit", 600), ("operating_profit", 300), ("net_profit", 200), ("interest_expense", 50), ("total_assets", 5000), ("current_assets", 1200), ("cash_and_equivalents", 400), ("total_liabilities", 3000),
        ("current_liabilities", 800), ("long_term_debt", 1000), ("short_term_debt", 500), ("total_equity", 2000), ("operating_cash_flow", 250), ("capex", 120)]


def test_full_ratio_set(spark):
    w = computed(spark, [cand(m, v) for m, v in FULL])
    got = one(ratios.compute(w))
    assert [got[r[0]] for r in R.RATIOS] == pytest.approx([1.5, 0.5, 0.75, 0.6, 6.0, 0.1, 0.15, 0.3, 0.4, 0.125, 130.0])
    assert ratios.warnings(w).count() == 0 and ratios.provenance(w).count() == 11


@pytest.mark.parametrize(("a", "b", "ratio"), [("standalone", "standalone", 1.5), ("standalone", "consolidated", None), ("standalone", "unknown", 1.5)])
def test_scope_guard(spark, a, b, ratio):
    w = computed(spark, [cand("current_assets", 1200, section=a), cand("current_liabilities", 800, section=b)])
    got = one(ratios.compute(w))
    assert got["current_ratio"] == ratio and (got["liquidity_risk"] == "Unknown") == (ratio is None)
    assert (ratios.warnings(w).filter("message like '%suppressed'").count() == 1) == (ratio is None)


def test_debt_scope_and_limits(spark):
    rows = [cand("long_term_debt", 1000, section="standalone"), cand("short_term_debt", 500, section="standalone"), cand("total_equity", 2000, section="consolidated")]
    got = one(ratios.compute(computed(spark, rows)))
    assert got["debt_to_equity"] is None and got["total_debt"] == 1500
    for equity, level in ((1500, "Low"), (-1500, "Low"), (700, "High"), (1000, "Medium")):
        assert one(ratios.compute(computed(spark, [cand("long_term_debt", 1500), cand("total_equity", equity)])))["debt_risk"] == level


def test_growth_over_a_gap_year_and_zero(spark):
    rows = [cand("revenue", 100, 2020), cand("revenue", 120, 2023, section="standalone"), cand("revenue", 0, 2024), cand("revenue", 5, 2025)]
    got = {r["year"]: r["yoy_revenue_growth"] for r in ratios.compute(computed(spark, rows)).collect()}
    assert got == {2020: None, 2023: pytest.approx(0.2), 2024: -1.0, 2025: None}


def test_resolution_order_and_ties(spark):
    rows = [cand("revenue", 1, section="standalone", seq=0), cand("revenue", 2, section="consolidated", confidence="low", seq=1), cand("revenue", 3, section="consolidated", confidence="low", label="Total revenue", seq=2),
            cand("revenue", 4, section="consolidated", confidence="low", label="total revenue", seq=3), cand("revenue", 9, year=1999)]
    for given in (rows, rows[::-1]):
        got = resolve.resolve(spark.createDataFrame(given, CAND)).collect()
        assert [r["value"] for r in got] == [3.0]


def test_derived_totals_read_the_snapshot_and_inherit_trust(spark):
    rows = [cand("current_liabilities", 10, state="VERIFIED"), cand("long_term_debt", 5), cand("total_equity", 7)]
    got = {r["metric_name"]: r for r in resolve.resolve(spark.createDataFrame(rows, CAND)).collect()}
    assert got["total_liabilities"]["value"] == 15 and got["total_liabilities"]["verification_state"] == "VERIFIED" and got["total_liabilities"]["confidence"] == "derived"
    assert "total_assets" not in got


def test_checks_and_quality(spark):
    rows = [cand("total_assets", 100), cand("total_equity", 50), cand("total_liabilities", 46), cand("revenue", 5), cand("net_profit", -6), cand("capex", 1, year=1990, doc="e")]
    c = spark.createDataFrame(rows, CAND)
    r = resolve.resolve(c)
    assert {x["kind"] for x in resolve.accounting_checks(resolve.pivot(r)).collect()} == {"balance", "profit"}
    q = {x["doc_id"]: x for x in resolve.quality(c, r).collect()}
    assert q["d"]["resolved_rows"] == 5 and q["e"]["issues"] == ["All candidates had invalid or missing years."] and "current_assets" in q["d"]["missing"]["2024"]


def test_trust(spark):
    def state(a, b, liabilities=800):
        return ratios.provenance(computed(spark, [cand("current_assets", 1200, state=a), cand("current_liabilities", liabilities, state=b)])).filter("ratio_name = 'current_ratio'").first()["state"]

    assert [state("VERIFIED", "VERIFIED"), state("VERIFIED", "NEEDS_REVIEW"), state("VERIFIED", None), state(None, None), state("VERIFIED", "VERIFIED", 0)] == ["VERIFIED", "NEEDS_REVIEW", "VERIFIED", None, None]
    w = computed(spark, [cand("operating_cash_flow", 1, state="NEEDS_REVIEW"), cand("current_assets", 2, state="VERIFIED"), cand("current_liabilities", 1)])
    s = one(ratios.risk_states(w))
    assert (s["liquidity"], s["cashflow"], s["overall"], s["debt"]) == ("VERIFIED", "NEEDS_REVIEW", "NEEDS_REVIEW", None)


BALANCE = "Consolidated Balance Sheet\n(₹ in crore)\nas at 31 March 2024 31 March 2023\nNon-current assets\nOther non-current assets\n1,200.00\nCurrent assets\n79,458 61,000\nTotal current liabilities 33,109.00 30,000.00\nTotal equity 126,731.94 110,000.00\nTotal assets 200,000.00 180,000.00\nequity and liabilities"
INCOME = "Notes\n24.\nRevenue from Operations\nStatement of Profit and Loss\n1,000.00\n2,000.00\n3,000.00\n4,000.00\n5,000.00\nrevenue expenses profit tax"


def page_frame(spark, texts, doc="d"):
    return spark.createDataFrame([(doc, i + 1, t) for i, t in enumerate(texts)], "doc_id string, page_no int, text string")


def test_classification(spark):
    p = page_frame(spark, [BALANCE, INCOME, "Management discussion and notes to accounts", "Balance Sheet\n1 2 3", None, "25.\nBalance Sheet\n" + "1,000 " * 6, "7%\n" + "5.25 % " * 9 + "\nBalance Sheet"])
    got = {r["page_no"]: r for r in pages.classify(p).collect()}
    assert [got[i]["statement_type"] for i in range(1, 8)] == ["balance_sheet", "income_statement", "notes", "other", "other", "balance_sheet", "other"]
    assert got[1]["section_type"] == "consolidated" and got[1]["score"] > got[6]["score"] > 0 and got[3]["score"] == 0
    assert [(r["statement_type"], r["page_no"]) for r in pages.select_pages(pages.classify(p)).orderBy("statement_type").collect()] == [("balance_sheet", 1), ("income_statement", 2)]
    same = pages.select_pages(spark.createDataFrame([("d", 3, "cash_flow", 1.0), ("d", 2, "cash_flow", 1.0)], "doc_id string, page_no int, statement_type string, score double"))
    assert sorted(r["page_no"] for r in same.collect()) == [2, 3]


def test_line_candidates(spark):
    p = page_frame(spark, [BALANCE])
    got = {(r["metric_name"], r["year"]): (r["value"], r["unit"]) for r in C.from_lines(p, pages.classify(p), pages.document_years(p)).collect()}
    assert got[("total_equity", 2024)] == (126731.94, "crore") and got[("total_assets", 2023)] == (180000.0, "crore") and got[("current_liabilities", 2024)][0] == 33109.0


def test_table_candidates(spark):
    t = spark.createDataFrame([("d", 1, "t", "", "unknown", [["Particulars", "2024", "2023"], ["", "₹ crore", "₹ crore"], ["Total assets", "(1,200)", "–"], ["Total equity", "700", "650"]])], "doc_id string, page_no int, table_id string, caption string, section_hint string, rows array<array<string>>")
    c = spark.createDataFrame([("d", 1, "balance_sheet", "standalone")], "doc_id string, page_no int, statement_type string, section_type string")
    got = {(r["metric_name"], r["year"], r["value"], r["section_type"], r["unit"]) for r in C.from_tables(t, c).collect()}
    assert got == {("total_assets", 2024, -1200.0, "standalone", "crore"), ("total_equity", 2024, 700.0, "standalone", "crore"), ("total_equity", 2023, 650.0, "standalone", "crore")}


def metric(**kw):
    return {"canonical_name": "total_equity", "raw_label": "Total equity", "value": 1, "unit": "crore", "year": 2024, "confidence": "high", "section_type": "standalone", "evidence": ""} | kw


def test_answers(spark):
    good = "```json\n" + json.dumps({"metrics": [metric(value="1,200", canonical_name=" Total Equity ", evidence="e" * 400, raw_label="l" * 300, confidence="odd"), metric(canonical_name="nonsense"), metric(year=1999), metric(value=None)]}) + "\n```"
    cut = json.dumps({"metrics": [metric()]})[:-4]
    loose = "text " + json.dumps(metric(value=3)) + " more " + json.dumps(metric(value=4, year=2023)) + ' {"canonical_name": "re'
    rows = [("a", "balance_sheet", 1, "unknown", good), ("b", "balance_sheet", 1, "consolidated", cut), ("c", "balance_sheet", 1, "unknown", loose), ("d", "balance_sheet", 1, "unknown", None)]
    frame = spark.createDataFrame(rows, "doc_id string, statement_type string, page_no int, section_type string, raw_json string")
    got = C.from_answers(C.parse_answers(frame)).orderBy("doc_id", "seq").collect()
    assert [(r["doc_id"], r["value"], r["confidence"], len(r["evidence"]), len(r["raw_label"])) for r in got] == [("a", 1200.0, "low", 350, 200), ("c", 3.0, "high", 0, 12), ("c", 4.0, "high", 0, 12)]


def test_page_merge(spark):
    rows = [cand("revenue", 100, page=1), cand("revenue", 100.5, page=2, state="VERIFIED"), cand("capex", 5, page=1), cand("capex", 9, page=2, state="VERIFIED")]
    got = {r["metric_name"]: r["value"] for r in C.merge_pages(spark.createDataFrame(rows, CAND)).collect()}
    assert got == {"revenue": 100.5, "capex": 5.0}


PAGE = grounding.key("Non-current assets\n12,000\nTotals\nCurrent assets\n(a) Inventories 5\n" + "x " * 60 + "\n79,458\nTotal\n33,109")


@pytest.mark.parametrize(("label", "evidence", "value", "want"), [
    ("Current assets", "Current assets\n79,458", 79458.0, (True, True, True)),
    ("current assets", "Current assets", 79458.0, (True, True, False)),
    ("total", "Total: 33,109", 259.0, (True, True, False)),
    ("urrent assets", "Current assets", 12000.0, (False, True, True)),
    ("Current assets", "Inventories\nCurrent assets", 5.0, (True, False, False)),
    ("12", "", 5.0, (False, False, False)),
])
def test_grounding(label, evidence, value, want):
    got = grounding.check(label, evidence, value, PAGE)
    assert (got[0], got[2], got[4]) == want


@pytest.mark.parametrize(("given", "want"), [
    ("Profit before tax 23,879.91", "Profit before tax\n23,879.91"), ("Tax paid: (2,314.03), 12", "Tax paid\n(2,314.03), 12"), ("Note F95", "Note F95"), ("Note 24", "Note 24"), ("year 2023-24", "year 2023-24"),
    ("a\n1,2", "a\n1,2"), ("1,234.5", "1,234.5"), ("", ""), ("Loan 5.1  ", "Loan\n5.1  "),
])
def test_unfusing(given, want):
    assert grounding.unfuse(given) == want and grounding.unfuse(want) == want


def test_unfusing_takes_linear_time():
    import time

    for text in ("Revenue from operations " + " ".join(["1,23,456"] * 38) + " and Total income", "x" + ",1" * 170, "a " + "1 ," * 115, "1,2 " * 80, "Revenue " + "(1.5), " * 50):
        began = time.perf_counter()
        grounding.unfuse(text[:350])
        assert time.perf_counter() - began < 0.01


def plain_check(label, evidence, value, page):
    """Grounding by a pattern per piece, one candidate at a time."""
    import re

    def found(pieces):
        at, start = 0, None
        for p in pieces:
            m = re.compile(r"(?<![^\W_])(?<!-)" + re.escape(p) + r"(?![^\W_])(?!-)").search(page, at)
            if m is None:
                return p
            start, at = m.start() if start is None else start, m.end()
        return None if start is None else (start, at)

    lb, q = found(grounding.anchors(label)), found(grounding.anchors(grounding.unfuse(evidence)))
    space = page
    if isinstance(q, tuple):
        first = page.find(page[q[0] : q[1]])
        near = any(grounding.same_value(n, value) for n in grounding.values_in(grounding.key(evidence)))
        space = page[first:] if near else page[first : first + q[1] - q[0] + grounding.REACH]
    hit = any(grounding.same_value(n, value) for n in grounding.values_in(space))
    return isinstance(lb, tuple), isinstance(q, tuple), hit and isinstance(q, tuple)


def test_grounding_equals_a_pattern_per_piece(spark, monkeypatch):
    """Random pages and quotations, several lots a block, a block without candidates and candidates without a block."""
    import random

    monkeypatch.setattr(grounding, "LOT", 40)
    rng = random.Random(7)
    words = ["Total assets", "assets-", "assets", " total ", "12,345 ", "(9.5) ", "\n", "x", "-", " ", "Net cash from", " operating activities 7 ", "é", "(a) "]
    blocks = {(d, c): "".join(rng.choices(words, k=150)) for d in "ab" for c in ("balance_sheet", "income_statement", "cash_flow")}
    rows = []
    for i in range(600):
        d, c = rng.choice([k for k in blocks if k != ("b", "cash_flow")])
        cut = lambda n: (lambda t, k: t[k : k + rng.randint(2, n)])(blocks[d, c], rng.randrange(len(blocks[d, c])))  # noqa: B023, E731
        rows.append((d, c, "revenue", cut(30), cut(60) + rng.choice(["", " 12,345", "\nassets"]), rng.choice([12345.0, 7.0, -9.5, 9.5, 3.0]), i))
    rows += [("none", "cash_flow", "revenue", "assets", "assets", 7.0, 600), ("a", "balance_sheet", "revenue", None, None, 7.0, 601)]
    frame = spark.createDataFrame(rows, "doc_id string, statement_type string, metric_name string, raw_label string, evidence string, value double, seq int")
    texts = spark.createDataFrame([(d, c, t) for (d, c), t in blocks.items()], "doc_id string, statement_type string, block string")
    got = {r["seq"]: (r["l3_passed"], r["l4_passed"], r["l5_passed"]) for r in grounding.validate(frame, texts).collect()}
    assert got == {r[6]: plain_check(r[3] or "", r[4] or "", r[5], grounding.key(blocks.get(r[:2], ""))) for r in rows}
    assert len({*got.values()}) > 4


def test_figures_of_a_page_are_read_once(monkeypatch):
    """However many candidates look from their quotation to the end of the page; a figure that a start cuts is cut."""
    import pyarrow as pa

    page = " ".join(f"line {'abcdefghij'[i % 10]} {i + 3000}.25 {i + 9000}" for i in range(200)) + " x 1,(2)34 -5 (6 9" + "9" * 320 + "-nil"
    places = grounding.Places(page, [])
    for at in range(len(page)):
        whole = [v for v in places.values(at, len(page)).tolist() if v == v]
        assert whole == grounding.values_in(page[at:]) and places.values(at, at + 40).tolist() == grounding.values_in(page[at : at + 40])
    read = []
    real = grounding.value_of
    monkeypatch.setattr(grounding, "value_of", lambda raw: read.append(raw) or real(raw))
    lines = [f"line {'abcdefghij'[i % 10]} {i + 3000}.25 {i + 9000}" for i in range(200)]
    claims = pa.Table.from_pylist([{"raw_label": "line a", "evidence": e, "value": float(i + 3000.25), "_lot": 0} for i, e in enumerate(lines)])
    met = grounding._met(claims, pa.table({"_page": [page]}))
    assert all(met.column("l5_passed").to_pylist()) and len(read) < 1000


def test_validation_reasons(spark):
    rows = [cand("current_assets", 79458, label="Current assets", seq=1)[:11] + ("Current assets\n79,458", None, None, None, None, None, 1), cand("revenue", 1, label="Current assets", seq=2)]
    blocks = spark.createDataFrame([("d", "balance_sheet", "Current assets\n79,458")], "doc_id string, statement_type string, block string")
    v = grounding.validate(spark.createDataFrame(rows, CAND), blocks)
    got = {r["seq"]: r["rejection_reasons"] for r in v.collect()}
    assert got[1] == [] and got[2] == ["raw_label_mismatch", "raw_label_not_grounded:fragment_not_found_in_order: 'current assets'", "evidence_not_grounded:no_text_anchor_in_evidence"]
    assert grounding.accepted(v).count() == 1 and grounding.rejections(v).count() == 1


def cash_table():
    t = [["", "", ""] for _ in range(42)]
    t[1] = ["Cash flows from operating activities", "", ""]
    t[20] = ["Purchase of property, plant and equipment", "(352)", "(400)"]
    t[30] = ["Net cash generated from operating activities", "33,547", "30,100"]
    t[32] = ["Net cash from operating activities", "21,989", "20,000"]
    t[34] = ["Cash flows from investing activities", "", ""]
    t[36] = ["", "(1,500)", "(900)"]
    t[38] = ["Twice", "77", "78"]
    t[39] = ["Again", "77", "79"]
    t[40] = ["Total equity", "126,731.94", "110,000"]
    return t


@pytest.mark.parametrize(("m", "value", "year", "label", "state", "row"), [
    ("capex", -352, 2025, "Purchase of property, plant and equipment", "VERIFIED", 20), ("operating_cash_flow", 21989, 2025, "Net cash from operating activities", "VERIFIED", 32),
    ("operating_cash_flow", 21989, 2024, "x", "NEEDS_REVIEW", 32), ("operating_cash_flow", 33547, 2025, "x", "NEEDS_REVIEW", 30), ("operating_cash_flow", 21989, 2025, "Net cash generated from operating activities", "NEEDS_REVIEW", 32),
    ("investing_cash_flow", -1500, 2025, "Cash flows from investing activities", "VERIFIED", 36), ("capex", 77, 2025, "x", "NEEDS_REVIEW", None), ("capex", 123456, 2025, "absent", "NEEDS_REVIEW", None),
    ("total_equity", 139009.95, 2025, "Total equity", "REJECTED", 40),
])
def test_structure(spark, m, value, year, label, state, row):
    t = spark.createDataFrame([("d", "c", 0, "1_t0", ["", "March 31, 2025", "2023-24"], cash_table())], "doc_id string, call string, ord int, table_id string, header array<string>, rows array<array<string>>")
    c = spark.createDataFrame([cand(m, value, year, label=label)], CAND).withColumn("call", F.lit("c")).withColumn("statement_type", F.lit("balance_sheet" if m == "total_equity" else "cash_flow"))
    got = one(structure.validate(c, structure.with_column_years(t)))
    assert (got["verification_state"], got["row_index"]) == (state, row), got["verification_reason"]
    assert one(structure.validate(c.withColumn("call", F.lit("other")), structure.with_column_years(t)))["verification_state"] == "NEEDS_REVIEW"


def test_ingest_end_to_end(spark):
    p = page_frame(spark, [BALANCE]).unionByName(page_frame(spark, [BALANCE], "lines"))
    answer = json.dumps({"metrics": [metric(value="126,731.94", evidence="Total equity 126,731.94"), metric(canonical_name="total_assets", raw_label="Total assets", value=200000, evidence="Total assets 200,000.00"),
                                     metric(canonical_name="current_liabilities", raw_label="Total current liabilities", value=33109, evidence="Total current liabilities\n33,109.00"), metric(canonical_name="current_assets", raw_label="Total current assets", value=5, evidence="none")]})
    answers = spark.createDataFrame([("d", "balance_sheet", answer)], "doc_id string, statement_type string, raw_json string")
    rows = [["Total current liabilities", "33,109.00", "30,000.00"], ["Total equity", "126,731.94", "110,000.00"], ["Total assets", "200,000.00", "180,000.00"]]
    tables = spark.createDataFrame([("d", 1, "1_t0", 0, ["", "31 March 2024", "31 March 2023"], rows)], "doc_id string, page_no int, table_id string, ord int, header array<string>, rows array<array<string>>")
    got = ingest(p, answers, tables)
    r = {(x["doc_id"], x["metric_name"], x["year"]): x for x in got.resolved.collect()}
    assert r[("d", "total_equity", 2024)]["verification_state"] == "VERIFIED" and r[("d", "total_equity", 2024)]["section_type"] == "consolidated"
    assert ("d", "current_assets", 2024) not in r and r[("lines", "total_equity", 2024)]["source"] == R.LINE_SOURCE
    assert got.rejected.count() == 1 and got.computed.filter("doc_id = 'd'").count() == 1


CASH = "Cash Flow Statement\nConsolidated\n31 March 2024 31 March 2023\nNet cash from operating activities 1,234.00 1,100.00\nNet cash from investing activities (2,345.00) (2,000.00)\nPurchase of property, plant and equipment 9,876.00 9,000.00"
MORE = "(continued)\nNet cash from financing activities 4,567.00 4,000.00\nNet cash from operating activities 1,234.00 1,100.00"


def test_cash_flow_pages_are_asked_again(spark):
    """Only where all pages together gave nothing; each page against itself, then merged."""
    p = page_frame(spark, [CASH, MORE]).unionByName(page_frame(spark, [CASH, MORE], "e"))
    one_ = lambda name, label, value, line: metric(canonical_name=name, raw_label=label, value=value, evidence=line)
    first = json.dumps({"metrics": [one_("operating_cash_flow", "Net cash from operating activities", 1234, "Net cash from operating activities 1,234.00"), one_("financing_cash_flow", "Net cash from financing activities", 4567, "Net cash from financing activities 4,567.00")]})
    second = json.dumps({"metrics": [one_("financing_cash_flow", "Net cash from financing activities", 4567, "Net cash from financing activities 4,567.00"), one_("operating_cash_flow", "Net cash from operating activities", 1234, "Net cash from operating activities 1,234.00")]})
    answers = spark.createDataFrame([("d", "cash_flow", '{"metrics": []}'), ("e", "cash_flow", first)], "doc_id string, statement_type string, raw_json string")
    alone = spark.createDataFrame([(x, n, a) for x in "de" for n, a in ((1, first), (2, second))], "doc_id string, page_no int, raw_json string")
    tables = spark.createDataFrame([], "doc_id string, page_no int, table_id string, ord int, header array<string>, rows array<array<string>>")
    got = ingest(p, answers, tables, alone)
    kept = sorted((r["doc_id"], r["metric_name"], r["page_no"]) for r in got.candidates.filter("source = 'llm_extraction'").collect())
    assert kept == [("d", "financing_cash_flow", 2), ("d", "operating_cash_flow", 1), ("e", "financing_cash_flow", 1), ("e", "operating_cash_flow", 1)]
    assert [(r["doc_id"], r["metric_name"]) for r in got.rejected.collect()] == [("d", "financing_cash_flow")]


def test_chunks(spark):
    text = "Key Risks\n" + "\n".join(f"Sentence {i} of the story goes on and on. And further." for i in range(60))
    p = page_frame(spark, [text, "Liquidity\nshort page", BALANCE])
    got = chunks.chunk(p, pages.classify(p)).orderBy("char_start").collect()
    whole = text + "\n" + "Liquidity\nshort page" + "\n"
    assert all(len(r["text"]) <= 800 and whole[r["char_start"] : r["char_end"]] == r["text"] for r in got)
    assert got[0]["section_title"] == "Key Risks" and got[0]["section_type"] == "risk_factors" and got[-1]["page_no"] in (1, 2)
    assert {r["page_no"] for r in got} <= {1, 2} and got[0]["chunk_id"] == "d_1_0"
    covered = sorted((r["char_start"], r["char_end"]) for r in got)
    assert all(b[0] <= a[1] + 2 for a, b in zip(covered, covered[1:]))


def test_one_long_document_is_cut_into_blocks(spark):
    """Offsets, pages and headings are those of one block, whatever the blocks, also over blocks without events."""
    import random

    rng = random.Random(4)
    text = lambda: "\n".join(rng.choice(["Key Risks", "Liquidity Position", "plain words that run on and on, without an end.", "x" * 300]) for _ in range(rng.randint(1, 6)))
    p = page_frame(spark, [text() for _ in range(90)]).unionByName(page_frame(spark, [text() for _ in range(3)], "short")).withColumn("statement_type", F.lit("other"))
    rows = lambda frame: sorted(map(repr, (tuple(r) for r in frame.collect())))
    whole = chunks.offsets(p)
    assert rows(chunks.offsets(p, block=7)) == rows(whole)
    n = whole.groupBy("doc_id").agg(F.max("char_end").alias("n"))
    parts = n.select("doc_id", F.posexplode(F.sequence(F.lit(0), F.col("n"), F.lit(37))).alias("i", "char_start")).select("doc_id", "i", F.lit("t").alias("text"), "char_start", (F.col("char_start") + 37).alias("char_end"))
    titles = chunks.headings(whole)
    want = rows(chunks.locate(parts, whole, titles))
    assert len(want) > 500 and rows(chunks.locate(parts, whole, titles, block=50)) == want and rows(chunks.locate(parts, whole, titles, block=1000)) == want


def test_top_k_ties(spark):
    v = spark.createDataFrame([("d", i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(10)], "doc_id string, vec_id int, embedding array<float>")
    q = spark.createDataFrame([("d", 1, [1.0, 0.0])], "doc_id string, query_id int, embedding array<float>")
    assert [r["vec_id"] for r in chunks.top_k(v, q, 3).orderBy("rank").collect()] == [1, 3, 5]


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(21)
    x = rng.standard_normal((300, 6)).astype("f4")
    x[40:120] = x[40]
    rows = [("hot" if i % 10 else "cold", i, v.tolist()) for i, v in enumerate(x)] + [("hot", 900, None), ("hot", 901, [1.0]), ("hot", 902, [float("nan")] * 6), ("hot", 903, [1.0, None] + [0.0] * 4), (None, 904, x[0].tolist())]
    v = spark.createDataFrame(rows, "doc_id string, vec_id int, embedding array<float>").repartition(5)
    q = v.filter("vec_id % 7 = 0 or vec_id >= 900").withColumnRenamed("vec_id", "query_id")

    def order(a, b):  # NaN first, no score last, as Spark sorts
        if not a or not b or len(a) != len(b) or None in a or None in b:
            return 2, 0.0
        s = sum((float(y) * float(z) for y, z in zip(a, b)), 0.0)
        return (0, 0.0) if s != s else (1, -s)

    want = {(i, r + 1, j) for d, i, a in rows if d and (i % 7 == 0 or i >= 900) for r, (_, j) in enumerate(sorted((order(a, b), j) for e, j, b in rows if e == d)[:4])}
    for sizes in ({}, {"rows": 32, "asked": 9}):
        assert {(r["query_id"], r["rank"], r["vec_id"]) for r in chunks.top_k(v, q, 4, **sizes).collect()} == want


def test_stored_index_is_searched_in_place(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((500, 6)).astype("f4")
    rows = [("hot" if i % 10 else "cold", i, v.tolist()) for i, v in enumerate(x)] + [("hot", 900, None), (None, 904, x[0].tolist())]
    v = spark.createDataFrame(rows, "doc_id string, vec_id int, embedding array<float>").repartition(5)
    q = v.filter("vec_id % 7 = 0 or vec_id >= 900").withColumnRenamed("vec_id", "query_id")
    chunks.store_index(v, "stored_vectors", rows=64, buckets=8)
    got = chunks.search_index(q, "stored_vectors", asked=20)
    rows_of = lambda frame: sorted(map(repr, (tuple(r) for r in frame.select("query_id", "rank", "vec_id", "score").collect())))
    assert rows_of(got) == rows_of(chunks.top_k(v, q, 4))
    plan = got._jdf.queryExecution().executedPlan().toString()
    vectors = [line for line in plan.splitlines() if "Exchange hashpartitioning(_key" in line]
    assert "Bucketed: true" in plan and not vectors
    spark.sql("DROP TABLE stored_vectors")


def test_ordered_files(spark, tmp_path):
    import pyarrow.parquet as pq

    frame = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"), (F.col("id") % 3).alias("k")).repartition(6)
    documents.write_ordered(frame, str(tmp_path / "out"), "k", F.col("v").desc(), partitions=5)
    files = sorted((tmp_path / "out").glob("part-*.parquet"))
    got = [(r["k"], -r["v"]) for f in files for r in pq.read_table(f).to_pylist()]
    assert len(files) == 5 and got == sorted(got) and len(got) == 5000


def test_top_k_search_asks_every_fiftieth_row(spark, tmp_path):
    from granary.queries import QUERIES

    rng = np.random.default_rng(22)
    x = rng.standard_normal((400, 5)).astype("f4").astype(float)
    rows = [(100 + i, i % 3, v.tolist()) for i, v in enumerate(x)]  # ids start above 19
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {(100 + i, r + 1, 100 + j) for i in range(0, 400, 50) for r, j in enumerate(sorted(range(i % 3, 400, 3), key=lambda j: (-(x[i] @ x[j]), j))[:4])}
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in QUERIES["top_k_search"](spark, str(tmp_path)).collect()} == want


def test_views_and_prompts(spark):
    r = resolve.resolve(spark.createDataFrame([cand(m, v, state="NEEDS_REVIEW" if m == "revenue" else None, section="standalone") for m, v in FULL], CAND))
    w = ratios.wide(r)
    q = spark.createDataFrame([("q", "d", "What about leverage?", "Revenue was fine")], "query_id string, doc_id string, question string, answer string")
    assert {(x["metric"], x["value"]) for x in views.mentions(q, ratios.compute(w), r).collect()} == {("debt_to_equity", 0.75), ("revenue", 2000.0)}
    got = one(prompts.prompts(q, prompts.resolved_section(r), prompts.computed_section(w), None))["prompt"]
    assert "  Revenue (2024): 2,000.00 crore (page 1) [standalone] [NEEDS_REVIEW: None]" in got and "  Free Cash Flow (2024): 130.0000 crore" in got and "  Current Ratio (2024): 1.5000\n" in got
    assert "No relevant document sections" in got and got.index("Income Statement:") < got.index("Balance Sheet:") < got.index("Cash Flow:")
    assert "- revenue: revenue from operations, turnover, sales" in extraction_prompts.label_hints("income_statement")
    assert views.missing_warning(ratios.compute(w)).count() == 0 and one(views.trust_summary(r))["needs_review"] == 1


def test_provenance_is_read_back_last_entry_first(spark):
    rows = [("d", "current_ratio", 2024, 1, 1.0), ("d", "current_ratio", 2024, 3, 3.0), ("d", "current_ratio", 2024, 2, 2.0), ("d", "current_ratio", 2023, 1, 9.0), ("e", "debt_ratio", 2024, 1, 5.0)]
    got = {r["doc_id"]: r["ratios"] for r in views.provenance_maps(spark.createDataFrame(rows, "doc_id string, ratio_name string, year int, seq int, result double")).collect()}
    assert {k: v["result"] for k, v in got["d"]["current_ratio"].items()} == {"2024": 3.0, "2023": 9.0} and set(got["e"]) == {"debt_ratio"}


def test_sources_and_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes("one\ftwo".encode())
    (tmp_path / "in/b.txt").write_bytes(b"\xff\xfe\xfa")
    got = documents.read_text_pages(spark, str(tmp_path / "in")).orderBy("page_no").collect()
    assert [(r["page_no"], r["text"]) for r in got] == [(None, None), (1, "one"), (2, "two")] and got[0]["error"]
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, v int")
    for frame in (rows, rows, spark.createDataFrame([("b", 3)], "doc_id string, v int")):
        documents.store(frame, str(tmp_path / "out"))
    assert sorted((r["doc_id"], r["v"]) for r in documents.load(spark, str(tmp_path / "out")).collect()) == [("a", 1), ("b", 3)]
    assert documents.load(spark, str(tmp_path / "none")) is None


def test_store_forgets_what_is_gone(spark, tmp_path):
    kind, at = "doc_id string, v int", str(tmp_path / "out")
    documents.store(spark.createDataFrame([(x, 1) for x in "abcdefgh"], kind), at)
    named = spark.createDataFrame([("a",), ("b",), ("z",)], "doc_id string")
    for _ in range(2):
        documents.store(spark.createDataFrame([("b", 2), ("b", 3)], kind), at, named)
        got = sorted((r["doc_id"], r["v"]) for r in documents.load(spark, at).collect())
        assert got == [("b", 2), ("b", 3), *((x, 1) for x in "cdefgh")]
    documents.store(spark.createDataFrame([], kind), at, documents.load(spark, at).select("doc_id"))
    assert documents.load(spark, at).count() == 0


def test_a_version_appears_whole_or_not_at_all(spark, tmp_path):
    at, kind = str(tmp_path / "s"), "doc_id string, v int"
    frame = lambda *rows: spark.createDataFrame(list(rows), kind)
    seen = lambda t="a", v=None: sorted((r["doc_id"], r["v"]) for r in versions.read(spark, at, t, v).collect())
    assert versions.read(spark, at) is None
    many = versions.replace(spark, f"{at}/wide", {"rows": frame(*((str(i), i) for i in range(40)))})
    assert len(many.folders("rows")) > 20 and versions.read(spark, f"{at}/wide").columns == ["doc_id", "v"] and versions.read(spark, f"{at}/wide").count() == 40
    first = versions.replace(spark, at, {"a": frame(("d", 1), ("e", 1)), "b": lambda made: made["a"].withColumn("v", F.col("v") * 10)})

    def dies():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):  # between the rows and the manifest
        versions.replace(spark, at, {"a": frame(("d", 2)), "b": frame(("d", 20))}, before_commit=dies)
    assert seen() == [("d", 1), ("e", 1)] and seen("b") == [("d", 10), ("e", 10)]
    versions.replace(spark, at, {"a": frame(("d", 2)), "b": frame(("d", 20))})
    assert seen() == [("d", 2), ("e", 1)] and seen("b") == [("d", 20), ("e", 10)] and seen("a", first) == [("d", 1), ("e", 1)]
    versions.tidy(spark, at, keep=1)
    assert seen() == [("d", 2), ("e", 1)] and len(list((tmp_path / "s/versions").glob("0*"))) == 1


def test_two_writers_both_get_through(spark, tmp_path, monkeypatch):
    at, kind = str(tmp_path / "s"), "doc_id string, v int"
    frame = lambda *rows: spark.createDataFrame(list(rows), kind)
    monkeypatch.setattr(versions, "BUCKETS", 2)  # so that both touch the same ones
    names = "abcdefgh"
    versions.replace(spark, at, {"rows": frame(*((n, 0) for n in names))})
    others = iter([("a", 1), ("b", 1), ("c", 1)])

    def meanwhile():
        if (row := next(others, None)) is not None:
            versions.replace(spark, at, {"rows": frame(row)})

    versions.replace(spark, at, {"rows": frame(("h", 9), ("a", 9))}, before_commit=meanwhile)
    got = {r["doc_id"]: r["v"] for r in documents.load(spark, at).collect()}
    assert got == {"a": 9, "b": 1, "c": 1, "h": 9, **{n: 0 for n in "defg"}} and documents.load(spark, at).count() == 8


def test_chunk_store(spark, tmp_path):
    rows = spark.createDataFrame([("d_1_0", "d", "text", [1.0, 0.0])], "chunk_id string, doc_id string, text string, embedding array<float>")
    with pytest.raises(FileNotFoundError):
        documents.load_chunks(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        documents.store_chunks(rows.drop("embedding"), str(tmp_path / "out"))
    documents.store_chunks(rows, str(tmp_path / "out"))
    assert one(documents.load_chunks(spark, str(tmp_path / "out")))["embedding"] == [1.0, 0.0]


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("d", float("nan"), [1, 2]), ("e", 1.5, None)], "doc_id string, v double, pages array<int>")
    for d in "de":  # one after the other: both stay
        documents.export(rows.filter(F.col("doc_id") == d), str(tmp_path / "csv"))
    documents.export(rows, str(tmp_path / "json"), "json")
    documents.export(rows, str(tmp_path / "gone"))
    documents.export(rows.filter("doc_id = 'e'").withColumn("v", F.lit(7.5)), str(tmp_path / "gone"), documents=rows.select("doc_id"))
    assert [(r["doc_id"], r["v"]) for r in documents.load(spark, str(tmp_path / "gone"), "csv").collect()] == [("e", "7.5")]
    assert sorted((r["doc_id"], r["pages"]) for r in documents.load(spark, str(tmp_path / "csv"), "csv").collect()) == [("d", "1; 2"), ("e", None)]
    assert sorted((r["doc_id"], r["v"]) for r in documents.load(spark, str(tmp_path / "json"), "json").collect()) == [("d", None), ("e", 1.5)]
    c = spark.createDataFrame([cand("revenue", 5, year=1900)], CAND)
    q = resolve.quality(c, resolve.resolve(c), spark.createDataFrame([("d",), ("none",)], "doc_id string"))
    got = {r["doc_id"]: json.loads(r["report"]) for r in documents.quality_json(q).collect()}
    assert got == {"d": {"candidate_rows": 1, "resolved_rows": 0, "missing_core_metrics_by_year": {}, "issues": ["All candidates had invalid or missing years."]},
                   "none": {"candidate_rows": 0, "resolved_rows": 0, "missing_core_metrics_by_year": {}, "issues": ["No candidate metrics extracted."]}}


def test_tables_of_pages(spark, tmp_path):
    """Header names apart from the rows, header in the first row, missing cells, failing parsers."""
    assert documents.last_pages(200) == (21, 200) and documents.last_pages(5) == (1, 5)
    (tmp_path / "a.pdf").write_bytes(b"x")
    (tmp_path / "b.pdf").write_bytes(b"yy")

    def parser(body):
        if body == b"yy":
            raise ValueError("unreadable")
        return [(3, ["Item", "2023-24"], [["Sales", None]]), (3, None, [["Item", "FY 2022"], ["Cost", "5"]]), (4, None, [])]

    t = documents.read_tables(spark, str(tmp_path), parser)
    got = {(r["page_no"], r["table_id"]): r for r in structure.from_extracted(t).collect()}
    assert set(got) == {(3, "3_t0"), (3, "3_t1")}
    a, b = got[3, "3_t0"], got[3, "3_t1"]
    assert a["rows"] == [["Sales", ""]] and a["col_years"] == {1: [2024]} and (a["row_count"], a["col_count"]) == (1, 2)
    assert b["rows"][0] == ["Item", "FY 2022"] and b["col_years"] == {1: [2022]}
    p = {r["ord"]: r for r in documents.promoted(t).collect()}
    assert p[1]["header"] == ["Item", "FY 2022"] and p[1]["rows"] == [["Cost", "5"]] and p[0]["header"] == ["Item", "2023-24"]


def test_guard_and_year_lists(spark):
    d = spark.createDataFrame([("a", "ready", "[2024, 2023]"), ("b", "processing", "[20"), ("c", "failed", None)], "doc_id string, status string, y string")
    asked = spark.createDataFrame([(x,) for x in "abcd"], "doc_id string")
    got = {r["doc_id"]: (r["ready"], r["error_code"]) for r in views.document_guard(asked, d).collect()}
    assert got == {"a": (True, None), "b": (False, "DOC_PROCESSING"), "c": (False, "DOC_FAILED"), "d": (False, "DOC_NOT_FOUND")}
    assert {r["doc_id"]: r["y"] for r in d.select("doc_id", views.year_list(F.col("y")).alias("y")).collect()} == {"a": [2024, 2023], "b": [], "c": []}


def test_extraction_prompts(spark):
    b = spark.createDataFrame([("d", "cash_flow", "TEXT"), ("d", "mda", "x")], "doc_id string, statement_type string, block string")
    got = one(extraction_prompts.extraction_prompts(b))
    assert got["prompt"].startswith("Statement type: cash_flow\n\nCanonical metric names you may use (use ONLY these):\noperating_cash_flow, investing_cash_flow, financing_cash_flow, capex\n\nCommon label variants")
    assert "\n--- DOCUMENT TEXT ---\nTEXT\n--- END OF TEXT ---\n\n" in got["prompt"] and "label disambiguation" in got["system"] and '"evidence"' in got["system"]
    assert "TOTAL rows" in extraction_prompts.system_prompt("balance_sheet") and "11." not in extraction_prompts.system_prompt("income_statement")
    with pytest.raises(ValueError):
        extraction_prompts.system_prompt("mda")
    plain = extraction_prompts.plain_alias
    assert plain("^long.?term debt$") == "long term debt" and plain(r"^a\(b\)$") == "a(b)" and plain("^a|b$") is None and plain("^a.b$") is None
    assert "total shareholders equity" in extraction_prompts.label_hints("balance_sheet") and "total_assets" not in extraction_prompts.label_hints("balance_sheet")


def test_drained_stream_repeats_safely(spark, tmp_path):
    from granary.streaming.refresh import drained, latest, windowed_counts

    frame = lambda hours: spark.createDataFrame([(f"2024-01-01 {h:02d}:10:00", "a") for h in hours], "ts string, event_type string").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type")
    got = {}
    for hours in ([1, 1, 2], [2, 3]):
        frame(hours).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.readStream.schema(frame([1]).schema).parquet(str(tmp_path / "in"))
        for _ in range(2):
            drained(windowed_counts(events), str(tmp_path / "out"), str(tmp_path / "state"))
        got = {r["start"].hour: r["n"] for r in latest(spark, str(tmp_path / "out"), ["start", "event_type"], ["n"]).collect()}
    assert got == {1: 2, 2: 2, 3: 1}


def test_stream_refresh_repeats_safely(spark, tmp_path):
    from granary.streaming.refresh import refresh

    frame = spark.createDataFrame([cand("revenue", 5), cand("capex", 1, doc="e")], CAND)
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    refresh(spark, str(tmp_path / "in"), frame.schema, str(tmp_path / "store"), str(tmp_path / "state"))
    spark.createDataFrame([cand("revenue", 7, section="consolidated", seq=1)], CAND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    refresh(spark, str(tmp_path / "in"), frame.schema, str(tmp_path / "store"), str(tmp_path / "state"))
    got = sorted((r["doc_id"], r["value"]) for r in versions.read(spark, str(tmp_path / "store"), "resolved").collect())
    assert got == [("d", 7.0), ("e", 1.0)]


def test_a_document_sent_again_replaces_itself(spark, tmp_path):
    """Also where the old candidate would outrank the new one, and where a metric is gone."""
    from granary.streaming.refresh import refresh

    sent = [[cand("revenue", 10, section="consolidated"), cand("capex", 1), cand("revenue", 4, doc="e")], [cand("revenue", 99)]]
    for rows in sent:
        spark.createDataFrame(rows, CAND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        refresh(spark, str(tmp_path / "in"), spark.createDataFrame(rows, CAND).schema, str(tmp_path / "store"), str(tmp_path / "state"))
    read = lambda t: versions.read(spark, str(tmp_path / "store"), t).collect()
    assert sorted((r["doc_id"], r["metric_name"], r["value"]) for r in read("resolved")) == [("d", "revenue", 99.0), ("e", "revenue", 4.0)]
    assert sorted((r["doc_id"], r["revenue"], r["capex"]) for r in read("pivot")) == [("d", 99.0, None), ("e", 4.0, None)]


def test_long_pages_take_linear_time(spark):
    """Work per line must not grow with the page: lines were split anew for each line, page units found for each."""
    import time

    from granary.operators import candidates, pages

    body = "\n".join(f"Revenue from operations {i},123.50 {i},456.25" for i in range(100, 4100))
    p = spark.createDataFrame([("d", 1, "Statement of Profit and Loss\nas at 31 March 2024 and 31 March 2023 (in crore)\n" + body)], "doc_id string, page_no int, text string")
    began = time.perf_counter()
    assert [tuple(r) for r in pages.select_pages(pages.classify(p)).collect()] == [("d", "income_statement", 0, 1)]
    assert time.perf_counter() - began < 20
    began = time.perf_counter()
    found = candidates.from_lines(p, pages.classify(p), pages.document_years(p))
    assert found.groupBy("metric_name", "unit", "year").count().orderBy("year").collect() == [("revenue", "crore", 2023, 4000), ("revenue", "crore", 2024, 4000)]
    assert time.perf_counter() - began < 20
