"""Metric candidates from model answers, table cells and page lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary import registry as R
from granary.functions.text import NUMBER, has_any, header_years, let, line_label, lines, match_metric, parse_value, top_lines, trim, unit_of
from granary.package import ship

ANSWER = "metrics array<struct<canonical_name:string,raw_label:string,value:string,unit:string,year:string,confidence:string,section_type:string,evidence:string>>, notes string"


def outermost(text: str) -> list[str]:
    """The stretches of a text from a brace that opens at depth 0 to the one that closes it: depths are the
    running sum over all braces, so a stretch that never closes holds nothing, nor does what it encloses."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    step = (letters == ord("{")).astype(np.int64) - (letters == ord("}"))
    at = np.flatnonzero(step)
    depth = np.cumsum(step[at])
    opens, closes = at[(step[at] > 0) & (depth == 1)], at[(step[at] < 0) & (depth == 0)]
    return [text[a : b + 1] for a, b in zip(opens.tolist(), closes.tolist(), strict=False)]


def _recovered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Answers that don't parse: their outermost objects that parse and name a metric, as one answer."""
    import json

    def parsed(body: str) -> dict:
        try:
            return json.loads(body)
        except json.JSONDecodeError:
            return {}

    for b in batches:
        found = [[one for one in map(parsed, outermost(text or "")) if "canonical_name" in one] for text in b["answer"]]
        yield b.assign(answer=[json.dumps({"metrics": f, "notes": "recovered"}) if f else None for f in found])


def strip_fence(answer: Column) -> Column:
    s = trim(answer)
    fenced = F.regexp_replace(F.regexp_replace(s, r"^```(?:json)?\n?", ""), r"\n?```\z", "")
    return F.when(s.startswith("```"), fenced).otherwise(s)


def parse_answers(answers: DataFrame, recover: bool = True) -> DataFrame:
    """Answer rows (doc_id, statement_type, page_no, section_type, raw_json) with parsed ``answer``; broken
    ones are repaired in Python, and only they leave the JVM."""
    a = answers.withColumn("text", strip_fence(F.col("raw_json")))
    parsed = F.from_json("text", ANSWER, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    # one value and nothing behind it: in an array it is followed by what was put there, and by no more
    framed = F.try_parse_json(F.concat(F.lit("["), "text", F.lit(",0]")))
    one = (F.try_variant_get(framed, "$[1]", "int") == 0) & F.try_variant_get(framed, "$[2]", "variant").isNull()
    whole = a.withColumn("answer", parsed).withColumn("ok", F.coalesce(one, F.lit(False)))
    good = whole.filter("ok").drop("ok", "text")
    if not recover:
        return good
    ship(answers.sparkSession)
    broken = whole.filter("not ok").select("doc_id", "statement_type", "page_no", "section_type", "raw_json", F.col("text").alias("answer"))
    fixed = broken.mapInPandas(_recovered, broken.schema).withColumn("answer", F.from_json("answer", ANSWER))
    return good.select(*fixed.columns).unionByName(fixed)


def from_answers(answers: DataFrame) -> DataFrame:
    """Candidates of parsed answers: a registry name, a value and a year of 2000 to 2100 are needed; the page's
    section wins over the model's; label, unit and evidence are cut at 200, 50 and 350 characters."""
    m = answers.select("doc_id", "statement_type", "page_no", F.col("section_type").alias("_page_section"), F.posexplode("answer.metrics").alias("seq", "m"))
    name = F.regexp_replace(F.lower(trim(F.coalesce("m.canonical_name", F.lit("")))), " ", "_")
    value = F.coalesce(F.col("m.value").try_cast("double"), parse_value(F.col("m.value")))
    value = F.when(~F.isnan(value), value)
    year = F.col("m.year").try_cast("int")
    confidence = F.when(F.col("m.confidence").isin("high", "medium", "low"), F.col("m.confidence")).otherwise("low")
    said = F.when(F.col("m.section_type").isin("consolidated", "standalone", "unknown"), F.col("m.section_type")).otherwise("unknown")
    out = m.select(
        "doc_id", name.alias("metric_name"), F.substring(F.coalesce("m.raw_label", F.lit("")), 1, 200).alias("raw_label"), value.alias("value"), F.substring(F.coalesce("m.unit", F.lit("")), 1, 50).alias("unit"),
        year.alias("year"), "page_no", "statement_type", F.when(F.col("_page_section") != "unknown", F.col("_page_section")).otherwise(said).alias("section_type"),
        confidence.alias("confidence"), F.lit("llm_extraction").alias("source"), F.substring(F.coalesce("m.evidence", F.lit("")), 1, 350).alias("evidence"), F.col("seq").cast("long").alias("seq"),
    )
    return out.filter(F.col("metric_name").isin(*R.METRIC_NAMES) & F.col("value").isNotNull() & F.col("year").between(2000, 2100))


def from_lines(pages: DataFrame, classes: DataFrame, years: DataFrame) -> DataFrame:
    """Candidates of page lines: years from the page's top twelve lines, else the document's, first two; prose
    and long lines are passed over; wide balance sheet lines are cut at gaps of twelve; at most two values a
    segment, year-like numbers dropped; what is left of the segment is the label."""
    p = pages.join(classes.filter(F.col("statement_type").isin(*R.STATEMENTS)), ["doc_id", "page_no"]).join(years, "doc_id", "left")
    used = let(header_years(top_lines(F.coalesce("text", F.lit("")), 12)), lambda own: F.slice(F.when(F.size(own) > 0, own).otherwise(F.coalesce("years", F.array().cast("array<int>"))), 1, 2))
    # What holds for a page is made before its lines are: a select with a generator would make it for every line.
    p = p.select("doc_id", "page_no", "statement_type", "section_type", "text", unit_of(F.col("text")).alias("unit"), used.alias("used"))
    p = p.select("doc_id", "page_no", "statement_type", "section_type", "unit", "used", F.posexplode(F.transform(lines(F.coalesce("text", F.lit(""))), trim)).alias("line_no", "line"))
    p = p.filter((F.length("line") > 0) & (F.length("line") <= 200) & ~has_any(F.lower("line"), R.PROSE))
    cut = F.filter(F.split("line", r"(?U)\s{12,}"), lambda x: F.length(trim(x)) > 0)
    parts = let(cut, lambda c: F.when((F.col("statement_type") == "balance_sheet") & (F.size(c) >= 2), c).otherwise(F.array("line")))
    p = p.select("*", F.posexplode(parts).alias("part_no", "part"))
    values = F.filter(F.array_compact(F.transform(F.regexp_extract_all("part", F.lit(NUMBER), F.lit(0)), parse_value)), lambda v: ~F.abs(v).between(2000, 2100))

    def of_label(vs: Column, label: Column) -> Column:
        """(metric_name, raw_label, i, value) of a segment whose label is a metric; each step is made once."""
        metric = let(line_label(label), lambda key: F.when(key != "", match_metric(key, F.col("statement_type"))))
        return let(metric, lambda m: F.when(m.isNotNull(), F.transform(F.slice(vs, 1, 2), lambda v, i: F.struct(m.alias("metric_name"), label.alias("raw_label"), i.alias("i"), v.alias("value")))))

    found = let(values, lambda vs: F.when(F.size(vs) > 0, let(trim(F.regexp_replace("part", NUMBER, " ")), lambda label: of_label(vs, label))))
    p = p.select("doc_id", "page_no", "statement_type", "section_type", "unit", "used", "line_no", "part_no", F.inline(found)).withColumn("year", F.get("used", F.col("i")))
    seq = ((F.col("page_no").cast("long") * 1_000_000 + F.col("line_no")) * 100 + F.col("part_no")) * 10 + F.col("i")
    return p.select("doc_id", "metric_name", "raw_label", "value", "unit", "year", "page_no", "statement_type", "section_type", F.lit("low").alias("confidence"), F.lit(R.LINE_SOURCE).alias("source"), F.lit("").alias("evidence"), seq.alias("seq"))


def year_columns(rows: Column) -> Column:
    """(col, year) of a table's header: its first two rows, column 0 left out; years are taken once, in order
    of column then row, one per cell."""
    head = F.slice(rows, 1, 2)
    width = F.coalesce(F.array_max(F.transform(head, lambda r: F.size(r))), F.lit(0))
    cells = F.flatten(F.transform(F.when(width > 1, F.sequence(F.lit(1), width - 1)).otherwise(F.array().cast("array<int>")), lambda c: F.transform(head, lambda r: F.struct(c.alias("col"), header_years(F.coalesce(F.get(r, c), F.lit(""))).alias("y")))))
    start = F.array().cast("array<struct<col:int,year:int>>")

    def take(acc: Column, x: Column) -> Column:
        new = F.get(F.filter(x["y"], lambda y: ~F.exists(acc, lambda a: a["year"] == y)), F.lit(0))
        return F.when(new.isNull(), acc).otherwise(F.concat(acc, F.array(F.struct(x["col"].cast("int").alias("col"), new.alias("year")))))

    return F.aggregate(cells, start, take)


def from_tables(tables: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidates of table cells: one per year column with a value, for rows whose label is a metric of the
    statement. Data starts at the first of the top three rows with neither year nor unit in a year column."""
    c = classes.select("doc_id", "page_no", F.col("statement_type").alias("_type"), F.col("section_type").alias("_section"))
    t = tables.join(c, ["doc_id", "page_no"], "left").withColumn("statement_type", F.coalesce("_type", F.lit("other"))).filter(F.col("statement_type").isin(*R.STATEMENTS))
    t = t.withColumn("section_type", F.when(F.col("section_hint") != "unknown", F.col("section_hint")).otherwise(F.coalesce("_section", F.lit("unknown"))))
    t = t.withColumn("cols", year_columns(F.col("rows")))
    header = lambda r: F.exists("cols", lambda k: (F.size(header_years(F.coalesce(F.get(r, k["col"]), F.lit("")))) > 0) | has_any(F.lower(F.coalesce(F.get(r, k["col"]), F.lit(""))), R.HEADER_HINTS))
    flags = F.transform(F.slice("rows", 1, 3), header)
    start = F.coalesce(F.nullif(F.array_position(flags, False), F.lit(0)) - 1, F.least(F.size("rows"), F.lit(3)))
    unit = F.when(unit_of(F.col("caption")) == "as_reported", F.when(F.col("_type").isNotNull(), "crore").otherwise("as_reported")).otherwise(unit_of(F.col("caption")))
    t = t.select("doc_id", "page_no", "table_id", "statement_type", "section_type", unit.alias("unit"), "cols", start.alias("start"), "rows")  # before rows are, see from_lines
    t = t.select("doc_id", "page_no", "table_id", "statement_type", "section_type", "unit", "cols", "start", F.posexplode("rows").alias("row_index", "row")).filter("row_index >= start")
    label = F.get(F.filter(F.transform("row", trim), lambda x: (x != "") & ~F.lower(x).isin("nan", "none")), F.lit(0))
    cells = lambda m, said: F.transform("cols", lambda k: F.struct(m.alias("metric_name"), said.alias("raw_label"), k.alias("k"), parse_value(F.get("row", k["col"])).alias("value")))
    found = let(label, lambda said: let(match_metric(line_label(said), F.col("statement_type")), lambda m: F.when(m.isNotNull(), F.filter(cells(m, said), lambda x: x["value"].isNotNull()))))
    t = t.select("doc_id", "page_no", "table_id", "statement_type", "section_type", "unit", "row_index", F.inline(found))
    seq = F.col("row_index").cast("long") * 1000 + F.col("k.col")
    return t.select("doc_id", "metric_name", "raw_label", "value", "unit", F.col("k.year").alias("year"), "page_no", "statement_type", "section_type", F.lit("high").alias("confidence"), F.lit(R.TABLE_SOURCE).alias("source"), F.lit("").alias("evidence"), seq.alias("seq"))


def merge_pages(candidates: DataFrame) -> DataFrame:
    """One candidate per metric and year over pages read alone: the first seen, unless a later one is within
    1 % of it and alone is VERIFIED. Needs page_no and seq for the order."""
    order = Window.partitionBy("doc_id", "metric_name", "year").orderBy("page_no", "seq")
    first = candidates.withColumn("_first", F.first("value").over(order)).withColumn("_state", F.first("verification_state").over(order)).withColumn("_n", F.row_number().over(order))
    near = (F.col("value") == F.col("_first")) | F.coalesce(F.try_divide(F.abs(F.col("_first") - F.col("value")), F.abs("value")) < 0.01, F.lit(False))
    better = (F.col("_n") > 1) & near & (F.col("verification_state") == "VERIFIED") & (F.coalesce("_state", F.lit("")) != "VERIFIED")
    pick = Window.partitionBy("doc_id", "metric_name", "year").orderBy(F.coalesce(better, F.lit(False)).desc(), "_n")
    return first.withColumn("_p", F.row_number().over(pick)).filter("_p = 1").drop("_first", "_state", "_n", "_p")
