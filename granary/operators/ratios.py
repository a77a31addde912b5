"""Ratios, growth, risks, provenance and trust, all from one wide row per document and year.

One aggregation gathers values, scopes, pages and trust states of a year side by side; everything after it is
a projection, but growth, which needs the row before and a sort within the document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary import registry as R
from granary.functions.text import trim, unit_key


#: What a wide row holds of a metric.
_FIELDS = ("value", "scope", "page_no", "state", "unit")


def wide(resolved: DataFrame) -> DataFrame:
    """doc_id, year; per metric and field a column ``metric__field``: value, scope (NULL if unknown), page_no, state, unit.
    There is one row of a metric and year, so each field is an aggregate of its own, and those that nobody reads are left
    out (fields of a struct would not be)."""
    scope = F.when(~F.col("section_type").isin("", "unknown"), F.col("section_type"))
    rows = resolved.select("doc_id", "year", "metric_name", "value", scope.alias("scope"), "page_no", F.col("verification_state").alias("state"), "unit")
    return rows.groupBy("doc_id", "year").agg(*[F.max(F.when(F.col("metric_name") == m, F.col(f))).alias(f"{m}__{f}") for m in R.METRIC_NAMES for f in _FIELDS])


def _value(metric: str) -> Column:
    if metric != "total_debt":
        return F.col(f"{metric}__value")
    ltd, std = F.col("long_term_debt__value"), F.col("short_term_debt__value")
    return F.when(ltd.isNotNull() | std.isNotNull(), F.coalesce(ltd, F.lit(0.0)) + F.coalesce(std, F.lit(0.0)))


def _conflict(inputs: list[str]) -> Column:
    """"m=scope, ..." by metric if the inputs that have a value span more than one known scope, else NULL."""
    parts = [F.when(F.col(f"{m}__value").isNotNull() & F.col(f"{m}__scope").isNotNull(), F.struct(F.lit(m).alias("m"), F.col(f"{m}__scope").alias("s"))) for m in sorted(inputs)]
    known = F.array_compact(F.array(*parts))
    text = F.array_join(F.transform(known, lambda x: F.concat(x["m"], F.lit("="), x["s"])), ", ")
    return F.when(F.size(F.array_distinct(F.transform(known, lambda x: x["s"]))) > 1, text)


def _ratio(name: str, top: str, bottom: str) -> Column:
    if name == "free_cash_flow":
        return _value(top) - F.abs(F.coalesce(_value(bottom), F.lit(0.0)))
    return F.try_divide(_value(top), _value(bottom))


def level(risk: str, c: Column, threshold: float = R.OCF_THRESHOLD) -> Column:
    """High, Medium or Low by the risk's driver, Unknown without one."""
    _, _, high, medium = next(r for r in R.RISKS if r[0] == risk)
    medium = threshold if risk == "cashflow_risk" else medium
    worse = (lambda x: c > x) if risk == "debt_risk" else (lambda x: c < x)
    return F.when(c.isNull(), "Unknown").when(worse(high), "High").when(worse(medium), "Medium").otherwise("Low")


def worst_risk(*risks: Column) -> Column:
    code = lambda r: sum((F.when(r == k, v).otherwise(0) for k, v in R.RISK_CODE.items()), F.lit(0))
    names = {v: k for k, v in R.RISK_CODE.items()}
    return F.element_at(F.array(*[F.lit(names[i]) for i in range(4)]), F.greatest(*[code(r) for r in risks]) + 1)


def worst_state(*states: Column) -> Column:
    """NEEDS_REVIEW before VERIFIED; NULL states count for nothing."""
    code = F.greatest(*[F.when(s == "NEEDS_REVIEW", 2).when(s == "VERIFIED", 1) for s in states], F.lit(None).cast("int"))
    return F.when(code == 2, "NEEDS_REVIEW").when(code == 1, "VERIFIED")


def compute(wide_rows: DataFrame, ocf_threshold: float = R.OCF_THRESHOLD, also: Sequence[Column] = ()) -> DataFrame:
    """doc_id, year, 17 base metrics, total_debt, 11 ratios, 3 growths, conflicts (ratio to the scopes that
    suppressed it), what is asked of a wide row ``also``, and 5 risks. Growth compares with the previous year that the
    document has, gap or not."""
    out = wide_rows
    for name, top, bottom, inputs in R.RATIOS:
        out = out.withColumn(f"_c_{name}", _conflict(inputs))
        out = out.withColumn(name, F.when(F.col(f"_c_{name}").isNull(), _ratio(name, top, bottom)))
    along = Window.partitionBy("doc_id").orderBy("year")
    growth = []
    for name, metric in R.GROWTH:
        before = F.lag(_value(metric)).over(along)
        growth.append(F.try_divide(_value(metric) - before, F.abs(before)).alias(name))
    base = [_value(m).alias(m) for m in R.METRIC_NAMES]
    conflicts = F.map_from_entries(F.array_compact(F.array(*[F.when(F.col(f"_c_{n}").isNotNull(), F.struct(F.lit(n).alias("key"), F.col(f"_c_{n}").alias("value"))) for n, *_ in R.RATIOS])))
    out = out.select("doc_id", "year", *base, _value("total_debt").alias("total_debt"), *[n for n, *_ in R.RATIOS], *growth, conflicts.alias("conflicts"), *also)
    risks = [level(r, F.col(source), ocf_threshold).alias(r) for r, source, *_ in R.RISKS]
    out = out.select("*", *risks)
    return out.withColumn("overall_risk", worst_risk(*[F.col(r) for r, *_ in R.RISKS]))


def provenance(wide_rows: DataFrame) -> DataFrame:
    """11 rows per document and year, results or not: ratio_name, formula_str, numerator, denominator, their
    values, result, source_pages (distinct, ascending), scope_warning, state, seq."""
    entries = []
    for i, (name, top, bottom, inputs) in enumerate(R.RATIOS):
        conflict = _conflict(inputs)
        formula = f"{top} - abs({bottom})" if name == "free_cash_flow" else f"{top} / {bottom}"
        result = F.when(conflict.isNull(), _ratio(name, top, bottom))
        states = [F.col(f"{m}__state") for m in (top, bottom) if m != "total_debt"]
        pages = F.sort_array(F.array_distinct(F.array_compact(F.array(*[F.col(f"{m}__page_no") for m in inputs]))))
        entries.append(F.struct(
            F.lit(i).alias("seq"), F.lit(name).alias("ratio_name"), F.lit(formula).alias("formula_str"), F.lit(top).alias("numerator"), F.lit(bottom).alias("denominator"),
            _value(top).alias("numerator_val"), _value(bottom).alias("denominator_val"), result.alias("result"), pages.alias("source_pages"),
            F.concat(F.lit("scope_mismatch: "), conflict).alias("scope_warning"), F.when(result.isNotNull(), worst_state(*states)).alias("state"),
        ))
    return wide_rows.select("doc_id", "year", F.explode(F.array(*entries)).alias("p")).select("doc_id", "year", "p.*")


def warnings(wide_rows: DataFrame) -> DataFrame:
    """doc_id, year, seq, message: suppressed ratios, zero denominators, missing interest, zero revenue."""
    notes: list[Column] = []
    year = F.col("year").cast("string")
    for name, top, bottom, inputs in R.RATIOS:
        conflict = _conflict(inputs)
        notes.append(F.concat(F.lit(f"{name} ("), year, F.lit("): inputs span different reporting scopes ("), conflict, F.lit("); ratio suppressed")))
        if name != "free_cash_flow":
            notes.append(F.when(conflict.isNull() & _value(top).isNotNull() & (_value(bottom) == 0), f"{name}: denominator is 0, result set to NaN"))
        if name == "interest_coverage":
            notes.append(F.when(_value(bottom).isNull(), F.concat(F.lit("interest_coverage NaN for "), year, F.lit(": interest_expense missing"))))
            notes.append(F.when(_value("revenue") == 0, F.concat(F.lit("Revenue is 0 for "), year, F.lit("; margin ratios set to NaN"))))
    return wide_rows.select("doc_id", "year", F.posexplode(F.array(*notes)).alias("seq", "message")).filter("message is not null")


def ratio_states(proven: DataFrame) -> DataFrame:
    return proven.select("doc_id", "year", "ratio_name", "state")


def _state(name: str, top: str, bottom: str, inputs: list[str]) -> Column:
    """Trust state of a ratio that has a result, else NULL."""
    ok = _conflict(inputs).isNull() & _ratio(name, top, bottom).isNotNull()
    return F.when(ok, worst_state(*[F.col(f"{m}__state") for m in (top, bottom) if m != "total_debt"]))


def state_map() -> Column:
    """Trust states of a wide row's ratios, by name."""
    return F.map_from_entries(F.sort_array(F.array(*[F.struct(F.lit(r[0]).alias("ratio_name"), _state(*r).alias("state")) for r in R.RATIOS])))


def risk_state_columns() -> list[Column]:
    """The trust state of each risk, of a wide row."""
    state = {r[0]: _state(*r) for r in R.RATIOS}
    return [state.get(source, F.col("operating_cash_flow__state")).alias(r.removesuffix("_risk")) for r, source, *_ in R.RISKS]


def overall_state() -> Column:
    """The worst of the states of the four risks."""
    return worst_state(*[F.col(r.removesuffix("_risk")) for r, *_ in R.RISKS]).alias("overall")


def risk_states(wide_rows: DataFrame) -> DataFrame:
    """doc_id, year and the trust state of each risk, the worst of the four for the overall one."""
    return wide_rows.select("doc_id", "year", *risk_state_columns()).select("*", overall_state())


def computed_units(wide_rows: DataFrame) -> DataFrame:
    """Units of free_cash_flow and total_debt, where all inputs of the year that are there agree in theirs but for
    case and a plural s; the first is given as it is written."""

    def agreed(*metrics: str) -> Column:
        units = F.array_compact(F.array(*[F.when(F.col(f"{m}__value").isNotNull(), trim(F.coalesce(F.col(f"{m}__unit"), F.lit("")))) for m in metrics]))
        kinds = F.array_distinct(F.transform(units, unit_key))
        return F.when((F.size(kinds) == 1) & ~F.array_contains(units, ""), F.try_element_at(units, F.lit(1)))

    return wide_rows.select("doc_id", "year", agreed("operating_cash_flow", "capex").alias("free_cash_flow_unit"), agreed("long_term_debt", "short_term_debt").alias("total_debt_unit"))
