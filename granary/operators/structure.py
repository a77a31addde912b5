"""Structural check: does a candidate's value stand in its own table cell, row and year column?

Candidates meet the cells of the pages their call read by an equi-join on (doc_id, call); closeness is its
residual. One aggregation per candidate then ranks what was hit, and one expression decides."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import column_years, match_metric, parse_value, trim

TOLERANCE = 0.005

# States and reasons as users and prompts see them.
REASONS = {
    "no table": ("NEEDS_REVIEW", "no structural table available for this page -- row/column identity unverifiable from structure alone"),
    "contradiction": ("REJECTED", "structural contradiction: row {label} (label matches raw_label verbatim), column for {year} contains {true}, not the declared value {value}"),
    "not found": ("NEEDS_REVIEW", "declared value {value} not found in any structural table cell on this page"),
    "other year": ("NEEDS_REVIEW", "value found at row {row} but in the {actual} column, not the declared {year} column"),
    "no single year": ("NEEDS_REVIEW", "value found at row {row} but that column's header maps to {years} year(s), not unambiguously {year}"),
    "several": ("NEEDS_REVIEW", "declared value+year combination matches {clean} structurally distinct rows on this page -- not uniquely identifiable"),
    "other row": ("NEEDS_REVIEW", "declared raw_label matches row {label}, but the declared value+year matches a different row ({row}) -- label/value row mismatch"),
    "subtotal": ("NEEDS_REVIEW", "row {row}'s label matches {metric}, but {n} rows on this page do (rows {rivals}) -- row {row} is not the last (most likely final-total) of them; likely an intermediate subtotal"),
    "final": ("VERIFIED", "row {row} uniquely identified by value+year; column matches declared year {year}; positionally final among {n} candidate rows for this metric"),
    "sole": ("VERIFIED", "row {row} uniquely identified by value+year; column matches declared year {year}"),
}


def printed(value: Column) -> Column:
    """A double in plain digits, the fewest that tell it, with a point."""
    digits = F.regexp_replace(value.cast("string").try_cast("decimal(38,17)").cast("string"), "0+$", "")
    return F.coalesce(F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits), value.cast("string"))


def listed(numbers: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(numbers, lambda x: x.cast("string")), ", "), F.lit("]"))


def row_key(label: Column) -> Column:
    return F.regexp_replace(F.lower(trim(F.coalesce(label, F.lit("")))), r"(?U)\s+", " ")


def with_column_years(tables: DataFrame, header: str = "header") -> DataFrame:
    """Adds col_years (column to years) from an array of header names."""
    pairs = F.transform(header, lambda x, i: F.struct(i.alias("key"), column_years(F.coalesce(x, F.lit(""))).alias("value")))
    return tables.withColumn("col_years", F.map_from_entries(F.filter(pairs, lambda p: F.size(p["value"]) > 0)))


def from_extracted(tables: DataFrame) -> DataFrame:
    """Extracted tables (doc_id, page_no, ord, header, rows) as structural ones: empty cells for missing ones,
    table_id "<page>_t<ord>", row_count, col_count, and years from the header names where there are any (the
    rows then hold data only), else from the first row. A table with neither rows nor header goes."""
    t = tables.withColumn("rows", F.transform("rows", lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit("")))))
    named = F.coalesce(F.size("header"), F.lit(0)) > 0
    t = t.withColumn("header", F.when(named, F.col("header")).otherwise(F.coalesce(F.get("rows", F.lit(0)), F.array().cast("array<string>")))).filter((F.size("rows") > 0) | (F.size("header") > 0))
    t = t.withColumn("table_id", F.concat(F.col("page_no").cast("string"), F.lit("_t"), F.col("ord").cast("string"))).withColumn("row_count", F.size("rows"))
    return with_column_years(t.withColumn("col_count", F.coalesce(F.array_max(F.transform("rows", F.size)), F.size("header"))))


def table_cells(tables: DataFrame) -> DataFrame:
    """doc_id, call, ord (tables' order within the call), table_id, row_index, col_index, cell_text,
    cell_value, years, row_label, has_number (beyond column 0)."""
    numeric = lambda r: F.exists(F.slice(r, 2, 100000), lambda c: parse_value(c).isNotNull())
    r = tables.select("doc_id", "call", "ord", "table_id", "col_years", F.posexplode("rows").alias("row_index", "row"))
    r = r.withColumn("row_label", trim(F.coalesce(F.get("row", F.lit(0)), F.lit("")))).withColumn("has_number", F.coalesce(numeric(F.col("row")), F.lit(False)))
    c = r.select("*", F.posexplode("row").alias("col_index", "cell_text"))
    years = F.coalesce(F.try_element_at("col_years", F.col("col_index")), F.array().cast("array<int>"))
    return c.select("doc_id", "call", "ord", "table_id", "row_index", "col_index", "cell_text", parse_value(F.col("cell_text")).alias("cell_value"), years.alias("years"), "row_label", "has_number")


def validate(candidates: DataFrame, tables: DataFrame) -> DataFrame:
    """Candidates (with a unique ``seq`` within doc_id and call) and verification_state, verification_reason,
    table_id, row_index, col_index. REJECTED: the row of that very label has another value in the column of
    that year. Tables have doc_id, call, ord, table_id, rows, col_years."""
    cells = table_cells(tables)
    key = ["doc_id", "call", "seq"]
    c = candidates.drop("verification_state", "verification_reason", "table_id", "row_index", "col_index")
    slim = c.select(*key, "value", "year", "metric_name", "statement_type", row_key(F.col("raw_label")).alias("_label"))

    rows = cells.groupBy("doc_id", "call", "ord", "table_id", "row_index").agg(F.first("row_label").alias("row_label"), F.first("has_number").alias("has_number"), F.map_from_entries(F.collect_list(F.struct("col_index", "cell_value"))).alias("cells"))
    sole = cells.filter(F.size("years") == 1).groupBy("doc_id", "call", "ord").agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct("col_index", F.element_at("years", 1).alias("y"))))).alias("sole"))
    data = rows.filter("has_number").join(sole, ["doc_id", "call", "ord"], "left").withColumn("_label", row_key(F.col("row_label")))
    at = F.min_by(F.struct("ord", "row_index", "table_id", "cells", "sole"), F.struct("ord", "row_index"))
    label = slim.filter("_label <> ''").join(data, ["doc_id", "call", "_label"]).groupBy(*key).agg(at.alias("lab"))

    near = slim.join(cells, ["doc_id", "call"]).filter((F.col("cell_value") - F.col("value") < TOLERANCE) & (F.col("value") - F.col("cell_value") < TOLERANCE))
    one = F.size("years") == 1
    kind = F.when(one & F.coalesce(F.try_element_at("years", F.lit(1)) == F.col("year"), F.lit(False)), 0).when(one, 1).otherwise(2)
    hit = F.struct("ord", "row_index", "col_index", "table_id", "years", "row_label")
    place = F.struct(F.col("kind"), "ord", "row_index", "col_index")
    hits = near.withColumn("kind", kind).groupBy(*key).agg(F.min_by(F.struct("kind", hit.alias("hit")), place).alias("best"), F.count_if(F.col("kind") == 0).alias("clean"))

    meant = data.select("doc_id", "call", "ord", "row_index", "row_label")
    types = slim.select("doc_id", "call", "statement_type").distinct()
    meant = meant.join(types, ["doc_id", "call"]).withColumn("metric_name", match_metric(F.col("row_label"), F.col("statement_type"))).filter("metric_name is not null")
    rival = meant.groupBy("doc_id", "call", "ord", "statement_type", "metric_name").agg(F.sort_array(F.collect_set("row_index")).alias("rivals"))
    some = tables.select("doc_id", "call").distinct().withColumn("has_tables", F.lit(True))

    d = c.join(hits, key, "left").join(label, key, "left").join(some, ["doc_id", "call"], "left").withColumn("ord", F.col("best.hit.ord"))
    d = d.join(rival, ["doc_id", "call", "ord", "statement_type", "metric_name"], "left")
    h, row = F.col("best.hit"), F.col("best.hit.row_index")
    column = F.array_min(F.map_keys(F.map_filter("lab.sole", lambda k, y: y == F.col("year"))))
    truth = F.try_element_at("lab.cells", column)
    own = F.coalesce(match_metric(h["row_label"], F.col("statement_type")) == F.col("metric_name"), F.lit(False)) & (F.size("rivals") > 1)
    none = F.lit(None)
    said = {"row": row, "year": F.col("year"), "value": printed(F.col("value")), "true": printed(truth), "label": F.col("lab.row_index"), "clean": F.col("clean"), "metric": F.col("metric_name"),
            "actual": F.try_element_at(h["years"], F.lit(1)), "years": F.when(F.size(h["years"]) > 0, listed(h["years"])).otherwise("no"), "n": F.size("rivals"), "rivals": listed(F.col("rivals"))}

    def verdict(name: str, table=none, r=none, k=none) -> Column:
        state, words = REASONS[name]
        parts = [said[p[1:-1]].cast("string") if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", words) if p]
        return F.struct(F.lit(state).alias("state"), F.concat(*[F.coalesce(p, F.lit("None")) for p in parts]).alias("reason"), table.cast("string").alias("table"), r.cast("int").alias("row"), k.cast("int").alias("col"))

    here = (h["table_id"], row, h["col_index"])
    found = (
        F.when(F.col("has_tables").isNull(), verdict("no table"))
        .when(F.col("best").isNull() & truth.isNotNull() & (F.abs(truth - F.col("value")) >= TOLERANCE), verdict("contradiction", F.col("lab.table_id"), F.col("lab.row_index"), column))
        .when(F.col("best").isNull(), verdict("not found"))
        .when(F.col("best.kind") == 1, verdict("other year", *here))
        .when(F.col("best.kind") == 2, verdict("no single year", *here))
        .when(F.col("clean") > 1, verdict("several"))
        .when((F.col("lab.ord") == h["ord"]) & (F.col("lab.row_index") != row), verdict("other row", *here))
        .when(own & (row != F.element_at("rivals", -1)), verdict("subtotal", *here))
        .when(own, verdict("final", *here))
        .otherwise(verdict("sole", *here))
    )
    d = d.withColumn("_v", found)
    return d.select(*c.columns, F.col("_v.state").alias("verification_state"), F.col("_v.reason").alias("verification_reason"), F.col("_v.table").alias("table_id"), F.col("_v.row").alias("row_index"), F.col("_v.col").alias("col_index"))


def kept(validated: DataFrame) -> DataFrame:
    return validated.filter("verification_state <> 'REJECTED'")


def last_rows(cells: DataFrame) -> DataFrame:
    """Each cell's table's last row, as a window over the table."""
    return cells.withColumn("last_row", F.max("row_index").over(Window.partitionBy("doc_id", "table_id")))
