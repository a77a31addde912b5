"""Deterministic statements made from the driver's tables, so that every operator has inputs at any scale.

Each function has its twin in SQL in ``granary.oracles``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary import registry as R
from granary.operators.resolve import View


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files: streams read a single file by a pattern only."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{{{name}.parquet}}")


def candidate_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, View]:
    """Rows of lineitem, one a candidate, and how candidates are read from them: years move by 20, metrics go round by
    part, documents by supplier. Each row has its metric's number and its year; the rest is lineitem's own."""
    at = (F.col("l_partkey") % 17 + 1).cast("int")
    number = F.element_at(F.array(*[F.lit(i + 1) for i in range(len(R.METRIC_NAMES))]), at)
    li = table(spark, sf_dir, "lineitem").withColumns({"metric": number, "year": F.year("l_shipdate") + 20})
    metric = F.element_at(F.array(*[F.lit(m) for m in R.METRIC_NAMES]), F.col("metric"))
    words = F.replace(metric, F.lit("_"), F.lit(" "))
    q = F.col("l_quantity")
    columns = {
        "doc_id": F.col("l_suppkey").cast("string"), "metric_name": metric,
        "value": F.when(F.col("l_discount") > 0.08, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")),
        "unit": F.when(F.col("l_linenumber") % 2 == 0, "INR crores").otherwise("INR crore"), "year": F.col("year"), "page_no": F.col("l_linenumber").cast("int"),
        "raw_label": F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("Total "), words)).otherwise(words),
        "statement_type": F.element_at(F.array(*[F.lit(m[1]) for m in R.METRICS]), F.col("metric")),
        "section_type": F.when(F.col("l_returnflag") == "A", "standalone").when(F.col("l_returnflag") == "N", "consolidated").otherwise("unknown"),
        "confidence": F.when(F.col("l_linestatus") == "F", "high").otherwise("low"), "source": F.when(F.col("l_tax") > 0.04, R.TABLE_SOURCE).otherwise(R.LINE_SOURCE),
        "evidence": F.concat(F.lit("order "), F.col("l_orderkey").cast("string")),
        "verification_state": F.when(q > 25, "VERIFIED").when(q > 10, "NEEDS_REVIEW"), "verification_reason": F.lit(None).cast("string"),
        "table_id": F.lit(None).cast("string"), "row_index": F.lit(None).cast("int"), "col_index": F.lit(None).cast("int"),
    }
    return li, View(columns, ["l_suppkey", "metric"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate per lineitem row (see ``candidate_rows``), all columns made."""
    li, view = candidate_rows(spark, sf_dir)
    return li.select(*[c.alias(name) for name, c in view.columns.items()], F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"))


def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: of each source, 400 rows in doc_id order make one paged document."""
    d = table(spark, sf_dir, "documents")
    group = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.floor(F.col("doc_id") / 400).cast("string"))
    return d.select(group.alias("doc_id"), (F.col("doc_id") % 400 + 1).cast("int").alias("page_no"), "text")


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as pages of fifty documents."""
    return table(spark, sf_dir, "pages").select((F.col("page_id") % 50).alias("doc_id"), (F.floor(F.col("page_id") / 50) + 1).cast("int").alias("page_no"), F.col("html").alias("text"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as uploads of varied names, sizes and types."""
    p = table(spark, sf_dir, "pages")
    i = F.col("page_id")
    return p.select(
        F.when(i % 3 == 0, F.col("url")).otherwise(F.concat("url", F.lit(".pdf"))).alias("name"), (F.length("html") * 20000).cast("long").alias("size"),
        F.when(i % 5 == 0, "text/html").otherwise("application/pdf").alias("mime"), F.lower("html").contains("table").alias("has_content"),
    )


def printed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as they are printed: grouped digits, losses in brackets, some with a currency or a dash."""
    li = table(spark, sf_dir, "lineitem")
    whole = F.format_number(F.floor("l_extendedprice"), 0)
    k = F.col("l_linenumber") % 4
    raw = F.when(k == 0, F.concat(F.lit("("), whole, F.lit(")"))).when(k == 1, F.concat(F.lit(" ₹ "), whole)).when(k == 2, F.concat(F.lit("Rs. "), whole)).otherwise("–")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", raw.alias("raw"))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column headers that name three years of an order in three ways."""
    y = F.year("o_orderdate") + 20
    s = lambda c: c.cast("string")
    text = F.concat(F.lit("As at 31 March "), s(y), F.lit(", FY "), s(y - 1), F.lit(" and "), s(y - 2), F.lit("-"), F.right(s(y - 1), F.lit(2)), F.lit(" or "), s(y + 1))
    return table(spark, sf_dir, "orders").select("o_orderkey", y.alias("y"), text.alias("header"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another deterministic choice among the same candidates: per document, core metric and year the largest."""
    c = candidates(spark, sf_dir).filter(F.col("metric_name").isin(*R.CORE) & F.col("year").between(2000, 2100))
    return c.groupBy("doc_id", "metric_name", "year").agg(F.max("value").alias("expected_value")).withColumn("status", F.lit("valid"))


#: Statements by page number: type, title, and (metric, label) of their lines.
STATEMENT_PAGES = [
    ("balance_sheet", "Balance Sheet", [("total_assets", "Total assets"), ("current_assets", "Total current assets"), ("cash_and_equivalents", "Cash and cash equivalents"), ("total_liabilities", "Total liabilities"),
                                        ("current_liabilities", "Total current liabilities"), ("long_term_debt", "Non-current borrowings"), ("short_term_debt", "Short term borrowings"), ("total_equity", "Total equity")]),
    ("income_statement", "Statement of Profit and Loss", [("revenue", "Revenue from operations"), ("gross_profit", "Gross profit"), ("operating_profit", "Operating profit"), ("net_profit", "Profit for the year"), ("interest_expense", "Finance costs")]),
    ("cash_flow", "Cash Flow Statement", [("operating_cash_flow", "Net cash from operating activities"), ("investing_cash_flow", "Net cash from investing activities"), ("financing_cash_flow", "Net cash from financing activities"), ("capex", "Purchase of property, plant and equipment")]),
]
#: Lines of a page that its table and its model answer hold.
TABLE_ROWS, ANSWER_ROWS = 12, 10


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of printed statements, a document per supplier: doc_id, page_no (1 to 3), pos, statement_type,
    metric_name, label, v1, v2 (this year's and last year's value), year, line."""
    li = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 3")
    of = lambda f: F.element_at(F.array(*[f(p) for p in STATEMENT_PAGES]), F.col("page_no"))
    pick = F.pmod(F.col("l_partkey"), of(lambda p: F.lit(len(p[2])))).cast("int") + 1
    named = lambda k: F.element_at(of(lambda p: F.array(*[F.lit(m[k]) for m in p[2]])), F.col("pick"))
    order = Window.partitionBy("l_suppkey", "l_linenumber").orderBy("l_orderkey", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    li = li.withColumn("pos", F.row_number().over(order)).withColumn("page_no", F.col("l_linenumber").cast("int")).withColumn("pick", pick)
    money = lambda c: F.format_number(c, 2)
    v1, v2 = F.round(F.col("l_extendedprice") + 10000, 2), F.round(F.col("l_quantity") * 100 + 10000 + F.col("l_discount"), 2)
    return li.select(
        F.col("l_suppkey").cast("string").alias("doc_id"), "page_no", "pos", of(lambda p: F.lit(p[0])).alias("statement_type"), named(0).alias("metric_name"), named(1).alias("label"),
        v1.alias("v1"), v2.alias("v2"), (F.pmod(F.col("l_suppkey"), F.lit(12)) + 2010).cast("int").alias("year"), F.concat(named(1), F.lit(" "), money(v1), F.lit(" "), money(v2)).alias("line"),
    )


def statement_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_no, text: the printed statements, and narrative pages 4 to 7 behind them."""
    text = lambda c: c.cast("string")
    lines = statement_lines(spark, sf_dir).groupBy("doc_id", "page_no", "year").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"))
    title = F.element_at(F.array(*[F.lit(p[1]) for p in STATEMENT_PAGES]), F.col("page_no"))
    name = F.concat(F.lit("Supplier#"), F.lpad("doc_id", 9, "0"), F.lit(" Limited"))
    head = F.concat(title, F.lit("\nConsolidated as at 31 March "), text(F.col("year")), F.lit(" and 31 March "), text(F.col("year") - 1), F.lit(" (₹ in crore)\n"), name, F.lit("\n"))
    rest = table(spark, sf_dir, "lineitem").filter("l_linenumber > 3").groupBy(F.col("l_suppkey").cast("string").alias("doc_id"), F.col("l_linenumber").cast("int").alias("page_no")).agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("page_no") % 2 == 0, "Notes to the accounts").otherwise("Management discussion")
    return lines.select("doc_id", "page_no", F.concat(head, "body").alias("text")).unionByName(rest.select("doc_id", "page_no", F.concat(kind, F.lit("\nOrders met: "), text(F.col("n"))).alias("text")))


def _rows(lines: DataFrame) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("pos", F.array("label", F.format_number("v1", 2), F.format_number("v2", 2)).alias("r")))), lambda x: x["r"])


def statement_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_no, ord, header, rows, caption, section_hint: a table per statement page, of its first lines."""
    lines = statement_lines(spark, sf_dir).filter(F.col("pos") <= TABLE_ROWS)
    header = F.array(F.lit("Particulars"), F.concat(F.lit("As at 31 March "), F.col("year").cast("string")), F.concat(F.lit("FY "), (F.col("year") - 1).cast("string")))
    return lines.groupBy("doc_id", "page_no", "year").agg(_rows(lines).alias("rows")).select("doc_id", "page_no", F.lit(0).alias("ord"), header.alias("header"), "rows", F.lit("(₹ in crore)").alias("caption"), F.lit("unknown").alias("section_hint"))


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, statement_type, page_no, section_type, raw_json: answers as a model gives them, plain, fenced, or
    cut off within an object, in turn."""
    li = statement_lines(spark, sf_dir).filter(F.col("pos") <= ANSWER_ROWS)
    value = F.when(F.col("pos") % 3 == 0, F.concat(F.lit('"'), F.format_number("v1", 2), F.lit('"'))).otherwise(F.regexp_replace(F.format_number("v1", 2), ",", ""))
    confidence = F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "sure"))), F.col("pos") % 4 + 1)
    name = F.initcap(F.replace("metric_name", F.lit("_"), F.lit(" ")))
    one = F.concat(F.lit('{"canonical_name":"'), name, F.lit('","raw_label":"'), "label", F.lit('","value":'), value, F.lit(',"unit":"INR crore","year":'), F.col("year").cast("string"), F.lit(',"confidence":"'), confidence, F.lit('","section_type":"standalone","evidence":"'), "line", F.lit('"}'))
    objects = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("o")))), lambda x: x["o"]), ",")
    a = li.groupBy("doc_id", "page_no", "statement_type").agg(objects.alias("objects"))
    whole = F.concat(F.lit('{"metrics":['), "objects", F.lit('],"notes":"n"}'))
    turn = F.col("doc_id").cast("int") % 3
    raw = F.when(turn == 0, whole).when(turn == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).otherwise(F.concat("objects", F.lit(',{"canonical_name":"rev')))
    return a.select("doc_id", "statement_type", "page_no", F.when(F.col("page_no") == 2, "unknown").otherwise("consolidated").alias("section_type"), raw.alias("raw_json"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with evidence on statement pages, in six kinds by position: right, an absent value, an unknown
    label, absent evidence, the wrong sign, and a value within tolerance."""
    kind = F.col("pos") % 6
    value = F.when(kind == 1, F.lit(1e12)).when(kind == 4, -F.col("v1")).when(kind == 5, F.col("v1") * 1.01).otherwise(F.col("v1"))
    label = F.when(kind == 2, "Unheard caption").otherwise(F.col("label"))
    evidence = F.when(kind == 3, "Absent words 1,234.50").otherwise(F.col("line"))
    return statement_lines(spark, sf_dir).select("doc_id", "page_no", "pos", "statement_type", "metric_name", label.alias("raw_label"), evidence.alias("evidence"), value.alias("value"), "year")


def cell_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates about table cells, in four kinds by position: right, last year's year, a value that the table
    lacks, and a label that it lacks."""
    kind = F.col("pos") % 4
    li = statement_lines(spark, sf_dir).filter(F.col("pos") <= TABLE_ROWS)
    return li.select(
        "doc_id", F.col("statement_type").alias("call"), F.col("pos").alias("seq"), "metric_name", "statement_type", F.when(kind == 3, "No such label").otherwise(F.col("label")).alias("raw_label"),
        F.when(kind == 2, F.col("v1") + 777777).otherwise(F.col("v1")).alias("value"), F.when(kind == 1, F.col("year") - 1).otherwise(F.col("year")).alias("year"),
    )


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, company_name, document_years (JSON, here and there malformed or missing), status: a row per supplier."""
    k = F.col("s_suppkey")
    years = F.when(k % 5 == 0, "[2023, ").when(k % 5 != 1, F.concat(F.lit("["), (k % 12 + 2010).cast("string"), F.lit(", "), (k % 12 + 2009).cast("string"), F.lit("]")))
    return table(spark, sf_dir, "supplier").select(k.cast("string").alias("doc_id"), F.col("s_name").alias("company_name"), years.alias("document_years"), F.element_at(F.array(*map(F.lit, ("ready", "processing", "failed"))), (k % 3 + 1).cast("int")).alias("status"))


def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, page_no, section_title, text: conversation turns as retrieved chunks of their conversation."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).cast("int").alias("rank"), (F.col("turn") % 3 + 1).cast("int").alias("page_no"), F.col("role").alias("section_title"), F.coalesce("text", F.lit("")).alias("text"))


def call_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, latency_s: a call for every third line of a supplier, some suppliers without any."""
    li = table(spark, sf_dir, "lineitem").filter("l_linenumber % 3 = 0 and l_suppkey % 7 <> 0")
    return li.select(F.col("l_suppkey").cast("string").alias("doc_id"), (F.col("l_quantity") / 8).alias("latency_s"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, doc_id, role, question, answer: every conversation turn asks about the supplier that follows its
    conversation's number, and names each phrase of a metric or ratio in turn."""
    from granary.operators.views import METRIC_PHRASES, RATIO_PHRASES

    c = table(spark, sf_dir, "conversations")
    phrases = [p for p, _ in [*RATIO_PHRASES, *METRIC_PHRASES]]
    phrase = F.element_at(F.array(*map(F.lit, phrases)), ((F.col("conv_id") * 8 + F.col("turn")) % len(phrases) + 1).cast("int"))
    key = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return c.select(key.alias("query_id"), (F.col("conv_id") + 1).cast("string").alias("doc_id"), "role", F.concat(F.lit("What of "), F.initcap(phrase), F.lit("? "), F.coalesce("text", F.lit(""))).alias("question"), F.col("text").alias("answer"))


def chat_events(conversations: DataFrame) -> DataFrame:
    """Conversation turns (also as a stream) as events of chat sessions: system turns reset, user turns ask, and
    assistant turns answer the question before them. Answers come late in every third session and fail in some,
    with a retry and its answer behind; some questions are followed by a reset before their answer, and some
    sessions pause for two hours."""
    c, t = F.col("conv_id"), F.col("turn")
    pause = F.when((c % 5 == 0) & (t >= 4), 7200).otherwise(0)
    at = c % 1440 * 60 + t * 60 + pause
    ask, fails = F.col("role") == "user", (c % 7 == 3) & (t % 4 == 1)
    event = lambda when, late, k, kind, request, text: F.when(when, F.struct((at + late).alias("s"), (t * 10 + k).alias("seq"), F.lit(kind).alias("kind"), request.cast("long").alias("request"), text.alias("text")))
    none, text, reply = F.lit(None).cast("string"), F.col("text"), F.col("role") == "assistant"
    late = F.when(c % 3 == 1, 130).otherwise(0)
    events = [
        event(F.col("role") == "system", F.lit(0), 0, "reset", F.lit(None), none), event(ask, F.lit(0), 1, "ask", t, F.concat(F.lit("  "), text, F.lit("\n"))),
        event(ask & ((c + t) % 6 == 4), F.lit(5), 2, "reset", F.lit(None), none), event(reply & ~fails, late, 3, "reply", t - 1, text), event(reply & fails, F.lit(0), 4, "fail", t - 1, F.lit("no answer")),
        event(reply & fails, F.lit(10), 5, "retry", t + 100, none), event(reply & fails, F.lit(20), 6, "reply", t + 100, text),
    ]
    start = F.timestamp_seconds(F.lit(1704067200) + F.col("e.s")).alias("at")
    return conversations.select(c.alias("session"), F.explode(F.array_compact(F.array(*events))).alias("e")).select("session", start, "e.seq", "e.kind", "e.request", "e.text")


def asked_calls(orders: DataFrame) -> DataFrame:
    """Orders (also as a stream) as calls of statements: doc_id, statement_type, asked_at."""
    kind = F.element_at(F.array(*[F.lit(p[0]) for p in STATEMENT_PAGES]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return orders.select(F.col("o_orderkey").cast("string").alias("doc_id"), kind.alias("statement_type"), F.col("o_orderdate").cast("timestamp").alias("asked_at"))


def given_answers(lineitem: DataFrame) -> DataFrame:
    """First lines of orders (also as a stream) as answers of their calls, as late as they were shipped."""
    kind = F.element_at(F.array(*[F.lit(p[0]) for p in STATEMENT_PAGES]), (F.col("l_orderkey") % 3 + 1).cast("int"))
    raw = F.concat(F.lit('{"metrics": [], "value": '), F.col("l_extendedprice").cast("string"), F.lit("}"))
    return lineitem.filter("l_linenumber = 1").select(F.col("l_orderkey").cast("string").alias("doc_id"), kind.alias("statement_type"), raw.alias("raw_json"), F.col("l_shipdate").cast("timestamp").alias("answered_at"))
