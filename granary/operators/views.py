"""Read views: metrics, ratios, risks, explanations, dashboards, mentions and warnings; trust summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary import registry as R
from granary.functions.text import ordered
from granary.operators import ratios

# Phrases of questions and answers, and the ratio or metric each names.
RATIO_PHRASES = [("current ratio", "current_ratio"), ("cash ratio", "cash_ratio"), ("debt to equity", "debt_to_equity"), ("debt-to-equity", "debt_to_equity"), ("debt ratio", "debt_ratio"),
                 ("interest coverage", "interest_coverage"), ("profit margin", "profit_margin"), ("net margin", "profit_margin"), ("operating margin", "operating_margin"), ("gross margin", "gross_margin"),
                 ("asset turnover", "asset_turnover"), ("ocf to revenue", "ocf_to_revenue"), ("free cash flow", "free_cash_flow"), ("revenue growth", "yoy_revenue_growth"), ("profit growth", "yoy_profit_growth"),
                 ("total debt", "total_debt"), ("liquidity", "current_ratio"), ("leverage", "debt_to_equity"), ("solvency", "debt_ratio"), ("profitability", "profit_margin")]
METRIC_PHRASES = [("revenue", "revenue"), ("gross profit", "gross_profit"), ("operating profit", "operating_profit"), ("net profit", "net_profit"), ("interest expense", "interest_expense"),
                  ("total assets", "total_assets"), ("current assets", "current_assets"), ("cash and cash equivalents", "cash_and_equivalents"), ("total liabilities", "total_liabilities"),
                  ("current liabilities", "current_liabilities"), ("long-term debt", "long_term_debt"), ("long term debt", "long_term_debt"), ("short-term debt", "short_term_debt"), ("short term debt", "short_term_debt"),
                  ("total equity", "total_equity"), ("operating cash flow", "operating_cash_flow"), ("investing cash flow", "investing_cash_flow"), ("financing cash flow", "financing_cash_flow"), ("capital expenditure", "capex"), ("capex", "capex")]
KEY_METRICS = ["current_ratio", "debt_to_equity", "profit_margin", "free_cash_flow", "operating_margin"]

#: Ratios of the ratio view.
VIEW_RATIOS = ["current_ratio", "cash_ratio", "debt_to_equity", "debt_ratio", "interest_coverage", "profit_margin", "operating_margin", "gross_margin", "asset_turnover", "ocf_to_revenue", "free_cash_flow", "yoy_revenue_growth", "yoy_profit_growth", "total_debt"]


def document_guard(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, ready, error_code for each asked doc_id: what reading the document runs into."""
    d = asked.select("doc_id").join(documents.select("doc_id", "status", F.lit(True).alias("there")), "doc_id", "left")
    code = F.when(F.col("there").isNull(), R.NOT_THERE)
    for status, c in R.GUARD_CODES.items():
        code = code.when(F.col("status") == status, c)
    return d.select("doc_id", code.isNull().alias("ready"), code.alias("error_code"))


def year_list(text: Column) -> Column:
    """A stored JSON list of years; none where it is missing or malformed."""
    return F.coalesce(F.from_json(text, "array<int>"), F.array().cast("array<int>"))


def metrics_view(documents: DataFrame, resolved: DataFrame) -> DataFrame:
    """doc_id, company_name, document_years and the document's resolved metrics of known year, by year; documents
    without any have an empty list."""
    columns = [c for c in resolved.columns if c != "doc_id"]
    own = resolved.filter("year is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("year", *[c for c in columns if c != "year"]))).alias("metrics"))
    d = documents.select("doc_id", "company_name", year_list(F.col("document_years")).alias("document_years")).join(own, "doc_id", "left")
    return d.withColumn("metrics", F.coalesce("metrics", F.array().cast(own.schema["metrics"].dataType)))


def years_of(resolved: DataFrame) -> DataFrame:
    """doc_id, years: distinct years of each document, ascending."""
    return resolved.filter("year is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set("year")).alias("years"))


def metric_at(resolved: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, metric_name, year, value for the wanted (doc_id, metric_name, year); absent and NULL values have no row."""
    return wanted.select("doc_id", "metric_name", "year").distinct().join(resolved.select("doc_id", "metric_name", "year", "value").filter("value is not null"), ["doc_id", "metric_name", "year"])


def upload_gates(uploads: DataFrame) -> DataFrame:
    """doc_id (twelve hex digits of md5 over name and size) and the first gate an upload fails: suffix, size,
    MIME type, content."""
    code = F.when(~F.lower("name").endswith(".pdf"), "INVALID_PDF").when(F.col("size") > R.UPLOAD_MOST_BYTES, "FILE_TOO_LARGE").when(F.col("mime") != "application/pdf", "INVALID_PDF").when(~F.col("has_content"), "INVALID_PDF")
    return uploads.select(doc_key(F.col("name"), F.col("size")).alias("doc_id"), code.alias("rejected"))


def doc_key(name: Column, size: Column) -> Column:
    return F.left(F.md5(F.concat(name, size.cast("string")).cast("binary")), F.lit(12))


def ratio_view(wide_rows: DataFrame) -> DataFrame:
    """Ratios of a year with a map of their trust states, from one reading of the wide rows; rows without a document
    have none."""
    known = wide_rows.filter(F.col("doc_id").isNotNull() & F.col("year").isNotNull())
    return ratios.compute(known, also=[ratios.state_map().alias("states")]).select("doc_id", "year", *VIEW_RATIOS, "states")


def risk_view(wide_rows: DataFrame) -> DataFrame:
    """Per document, year and risk: level, ratio_used, driver value, threshold in words, trust state; the overall
    risk has neither driver nor threshold. Wide rows are read once."""
    c = ratios.compute(wide_rows, also=ratios.risk_state_columns()).select("*", ratios.overall_state())
    none = F.lit(None).cast("string")

    def one(risk: str, source: str | None) -> Column:
        name = risk.removesuffix("_risk")
        driver = F.col(source) if source else F.lit(None).cast("double")
        used = F.lit(source) if source in R.RISK_OF_RATIO else none
        threshold = F.lit(R.THRESHOLDS[risk]) if risk in R.THRESHOLDS else none
        return F.struct(F.lit(name).alias("risk"), F.col(risk).alias("level"), used.alias("ratio_used"), driver.alias("driver"), threshold.alias("threshold"), F.col(name).alias("state"))

    rows = F.array(*[one(r, s) for r, s, *_ in R.RISKS], one("overall_risk", None))
    return c.select("doc_id", "year", F.explode(rows).alias("r")).select("doc_id", "year", "r.*")


def explain(wide_rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """Each ratio of a document's latest year with the source rows of its two inputs and, for the ratios that a
    risk is read from, risk_type, risk_level and threshold."""
    p = ratios.provenance(wide_rows)
    p = p.withColumn("_last", F.max("year").over(Window.partitionBy("doc_id"))).filter("year = _last").drop("_last")
    side = lambda s: resolved.select("doc_id", "year", F.col("metric_name").alias(s), F.struct("unit", "page_no", "raw_label", "evidence", "verification_state", "table_id", "row_index", "col_index").alias(f"{s}_row"))
    p = p.join(side("numerator"), ["doc_id", "year", "numerator"], "left").join(side("denominator"), ["doc_id", "year", "denominator"], "left")
    risk = ordered([(r, F.col("ratio_name") == ratio) for ratio, r in R.RISK_OF_RATIO.items()])
    level = lambda r: ratios.level(r, F.col("result"))
    each = lambda f: F.coalesce(*[F.when(F.col("risk") == r, f(r)) for r in R.RISK_OF_RATIO.values()])
    p = p.withColumn("risk", risk)
    return p.select("*", F.regexp_replace("risk", "_risk$", "").alias("risk_type"), each(level).alias("risk_level"), each(lambda r: F.lit(R.THRESHOLDS[r])).alias("threshold")).drop("risk")


def provenance_maps(entries: DataFrame, order: str = "seq") -> DataFrame:
    """doc_id, ratios: a saved provenance list read back as ratio to year (text) to entry; of several entries of a
    ratio and year the last by ``order`` stands. Entries have doc_id, ratio_name, year and further columns."""
    columns = [c for c in entries.columns if c not in ("doc_id", "ratio_name", "year")]
    last = entries.groupBy("doc_id", "ratio_name", "year").agg(F.max_by(F.struct(*columns), order).alias("entry"))
    years = last.groupBy("doc_id", "ratio_name").agg(F.map_from_entries(F.collect_list(F.struct(F.col("year").cast("string"), F.col("entry")))).alias("years"))
    return years.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("ratio_name", "years"))).alias("ratios"))


def trust_summary(resolved: DataFrame) -> DataFrame:
    s = F.col("verification_state")
    return resolved.groupBy("doc_id").agg(F.count_if(s == "VERIFIED").alias("verified"), F.count_if(s == "NEEDS_REVIEW").alias("needs_review"), F.count_if(s.isNull()).alias("unverified"))


def mentions(questions: DataFrame, computed: DataFrame, resolved: DataFrame) -> DataFrame:
    """query_id, metric, year, value: what question and answer name, ratios for all years and resolved
    metrics where they exist. Phrases are found natively; one join per kind brings the values."""
    said = F.lower(F.concat_ws(" ", F.coalesce("answer", F.lit("")), F.coalesce("question", F.lit(""))))
    named = lambda table: F.array_distinct(F.array_compact(F.array(*[F.when(said.contains(p), m) for p, m in table])))
    q = questions.select("query_id", "doc_id", named(RATIO_PHRASES).alias("r"), named(METRIC_PHRASES).alias("m"))
    names = sorted({m for _, m in RATIO_PHRASES})
    long = computed.select("doc_id", "year", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("x")).select("doc_id", "year", "x.*")
    a = q.select("query_id", "doc_id", F.explode("r").alias("metric")).join(long, ["doc_id", "metric"])
    b = q.select("query_id", "doc_id", F.explode("m").alias("metric")).join(resolved.select("doc_id", F.col("metric_name").alias("metric"), "year", "value"), ["doc_id", "metric"])
    return a.select("query_id", "metric", "year", "value").unionByName(b.select("query_id", "metric", "year", "value"))


def missing_warning(computed: DataFrame) -> DataFrame:
    """doc_id, warning: key metrics a document lacks, in year, then metric order; none, none."""
    parts = F.array_compact(F.array(*[F.when(F.col(m).isNull(), F.struct(F.col("year"), F.lit(i).alias("i"), F.concat(F.lit(f"{m} not available for "), F.col("year").cast("string")).alias("t"))) for i, m in enumerate(KEY_METRICS)]))
    g = computed.select("doc_id", F.explode(parts).alias("p")).groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return g.select("doc_id", F.array_join(F.transform("ps", lambda x: x["t"]), "; ").alias("warning"))


def answered_pairs(turns: DataFrame) -> DataFrame:
    """Conversation turns that stay in the history: a user turn followed by an assistant's, and that one."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = turns.withColumn("_next", F.lead("role").over(w)).withColumn("_last", F.lag("role").over(w))
    return t.filter(((F.col("role") == "user") & (F.col("_next") == "assistant")) | ((F.col("role") == "assistant") & (F.col("_last") == "user"))).drop("_next", "_last")
