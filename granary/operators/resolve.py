"""Candidates to one value per document, metric and year; derived totals, checks, quality, pivot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary import registry as R
from granary.functions.text import printed

KEYS = ["doc_id", "metric_name", "year"]
#: Columns of a resolved row, in order.
CONTRACT = ["doc_id", "metric_name", "value", "unit", "year", "page_no", "raw_label", "statement_type", "section_type", "confidence", "source", "evidence",
            "verification_state", "verification_reason", "table_id", "row_index", "col_index"]


def _rank(c: Column, table: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def valid_years(candidates: DataFrame) -> DataFrame:
    return candidates.filter(F.col("year").between(2000, 2100)).withColumn("year", F.col("year").cast("int"))


@dataclass(frozen=True)
class View:
    """How candidates are read from rows that are narrower than they are: ``columns`` of the contract as expressions
    over a row; names of the row's columns that are equal exactly where document and metric are (``keys``), and of
    those that order what ranks equal (``order``). Rows have a ``year`` as candidates do."""

    columns: dict[str, Column]
    keys: list[str]
    order: list[str]


def _order(of: dict[str, Column]) -> Column:
    """How well a candidate ranks, the higher the better: section, confidence, source, a label of a total."""
    source = F.coalesce((of["source"] == R.TABLE_SOURCE).cast("int") + 1, F.lit(0))
    total = F.coalesce(F.lower(of["raw_label"]).startswith("total "), F.lit(False)).cast("int")
    return ((_rank(of["section_type"], R.SECTION_RANK, 1) * 100 + _rank(of["confidence"], R.CONFIDENCE_RANK, 0)) * 3 + source) * 2 + total


def best_candidates(candidates: DataFrame, view: View | None = None) -> DataFrame:
    """The best candidate per document, metric and year. ``seq`` orders what ranks equal; the rank filter
    runs before the shuffle too, so a hot key sends one row a task. Rank is one number, made before the sort, so
    that the columns behind it are sorted and spilled only where they are asked for. With a ``view`` the rows
    themselves are sorted, and only those that stay become candidates."""
    view = view or View({c: F.col(c) for c in CONTRACT}, KEYS[:2], ["seq"])
    ranked = valid_years(candidates).withColumn("_order", _order(view.columns))
    rank = F.row_number().over(Window.partitionBy(*view.keys, "year").orderBy(F.desc("_order"), *view.order))
    return ranked.withColumn("_rank", rank).filter("_rank = 1").select(*[view.columns[c].alias(c) for c in CONTRACT])


#: Totals and what they follow from, as they are called below.
_PARTS = {"cl": "current_liabilities", "ltd": "long_term_debt", "std": "short_term_debt", "tl": "total_liabilities", "ta": "total_assets", "eq": "total_equity"}


def _with_totals(best: DataFrame, only: bool) -> DataFrame:
    """Resolved rows and the totals derived from them, or these alone. A row of the first summand makes the
    total, as its other columns are the total's; the values beside it come from a window over the year. A row is
    doubled by the name of its total alone, so columns that nobody asks for are not carried here."""
    year = Window.partitionBy("doc_id", "year")
    d = best.select("*", *[F.max(F.when(F.col("metric_name") == m, F.col("value"))).over(year).alias(f"_{k}") for k, m in _PARTS.items()])
    total = F.when((F.col("metric_name") == _PARTS["cl"]) & F.col("_tl").isNull() & F.col("_cl").isNotNull() & F.col("_ltd").isNotNull(), "total_liabilities")
    total = total.when((F.col("metric_name") == _PARTS["eq"]) & F.col("_ta").isNull() & F.col("_eq").isNotNull() & F.col("_tl").isNotNull(), "total_assets")
    d = d.withColumn("_made", F.explode(F.array_compact(F.array(total) if only else F.array(F.lit(""), total))))
    made = F.col("_made")
    values = F.when(made == "total_liabilities", F.col("_cl") + F.col("_ltd") + F.coalesce("_std", F.lit(0.0))).when(made == "total_assets", F.col("_eq") + F.col("_tl"))
    label = F.when(made == "total_liabilities", "derived(cl+ltd+std)").when(made == "total_assets", "derived(equity+liab)")
    new = {"metric_name": made, "value": values.cast(best.schema["value"].dataType), "raw_label": label, "statement_type": F.lit("balance_sheet"), "confidence": F.lit("derived"), "source": F.lit(R.LINE_SOURCE)}
    return d.select(*[F.when(made == "", F.col(c)).otherwise(new[c]).alias(c) if c in new else F.col(c) for c in CONTRACT])


def derived_totals(resolved: DataFrame) -> DataFrame:
    """Rows for totals that are missing but follow from others of the year: total_liabilities from current
    liabilities and debts, total_assets from equity and reported liabilities. Both read what was resolved, so
    a derived total_liabilities feeds nothing. The rest of a row is that of its first summand, its trust state
    included; confidence ``derived`` marks it."""
    return _with_totals(resolved.filter(F.col("metric_name").isin(*_PARTS.values())), True)


def resolve(candidates: DataFrame, view: View | None = None) -> DataFrame:
    """The best candidates and the totals derived from them (see ``derived_totals``); ``view`` as in ``best_candidates``.

    Candidates are read once; what follows finds rows partitioned by document and year, and columns that
    nobody asks for are read and shuffled nowhere."""
    return _with_totals(best_candidates(candidates, view), False)


def pivot(resolved: DataFrame) -> DataFrame:
    """One row per document and year with all metrics, absent ones NULL; one aggregation, no value scan."""
    return resolved.groupBy("doc_id", "year").agg(*[F.max(F.when(F.col("metric_name") == m, F.col("value"))).alias(m) for m in R.METRIC_NAMES])


def accounting_checks(pivoted: DataFrame) -> DataFrame:
    """doc_id, year, seq, kind, left, right, relative_error, message of every failed check: a balance sheet out
    by more than 3 %, a net profit that exceeds revenue."""
    a, rhs = F.col("total_assets"), F.col("total_equity") + F.col("total_liabilities")
    error = F.abs(a - rhs) / F.greatest(F.abs(a), F.abs(rhs), F.lit(1.0))
    r, p = F.col("revenue"), F.col("net_profit")
    kinds = F.array(
        F.when(error > 0.03, F.struct(F.lit(1).alias("seq"), F.lit("balance").alias("kind"), a.alias("left"), rhs.alias("right"), error.alias("relative_error"),
               F.format_string("Year %d: total_assets (%s) ≠ total_equity + total_liabilities (%s) — relative error %s%%", "year", printed(a, 0), printed(rhs, 0), printed(error * 100, 2)).alias("message"))),
        F.when((F.abs(r) > 0) & (F.abs(p) > F.abs(r)), F.struct(F.lit(2).alias("seq"), F.lit("profit").alias("kind"), p.alias("left"), r.alias("right"), F.lit(None).cast("double").alias("relative_error"),
               F.format_string("Year %d: net_profit (%s) exceeds revenue (%s) — possible extraction error", "year", printed(p, 0), printed(r, 0)).alias("message"))),
    )
    return pivoted.select("doc_id", "year", F.explode(F.array_compact(kinds)).alias("c")).select("doc_id", "year", "c.*")


def missing_core(pivoted: DataFrame) -> DataFrame:
    """doc_id, year and the core metrics it lacks, in core order; years that lack none are left out."""
    lacks = F.array_compact(F.array(*[F.when(F.col(m).isNull(), m) for m in R.CORE]))
    return pivoted.select("doc_id", "year", lacks.alias("missing")).filter(F.size("missing") > 0)


def quality(candidates: DataFrame, resolved: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Per document: candidate_rows, resolved_rows, missing (year to core metrics), issues (messages). With
    ``documents`` (doc_id), those without a candidate have a row as well."""
    wide = pivot(resolved)
    n = candidates.groupBy("doc_id").agg(F.count(F.lit(1)).alias("candidate_rows"))
    n = n if documents is None else documents.select("doc_id").distinct().join(n, "doc_id", "left")
    r = resolved.groupBy("doc_id").agg(F.count(F.lit(1)).alias("resolved_rows"))
    m = missing_core(wide).groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("year").cast("string"), "missing")))).alias("missing"))
    i = accounting_checks(wide).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("year", "seq", "message"))).alias("i"))
    out = n.join(r, "doc_id", "left").join(m, "doc_id", "left").join(i, "doc_id", "left")
    none = F.when(F.col("candidate_rows").isNull(), F.array(F.lit("No candidate metrics extracted."))).when(F.col("resolved_rows").isNull(), F.array(F.lit("All candidates had invalid or missing years.")))
    issues = F.coalesce(none, F.transform("i", lambda x: x["message"]), F.array().cast("array<string>"))
    return out.select("doc_id", F.coalesce("candidate_rows", F.lit(0)).alias("candidate_rows"), F.coalesce("resolved_rows", F.lit(0)).alias("resolved_rows"), "missing", issues.alias("issues"))
