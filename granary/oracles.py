"""DuckDB SQL of the registered queries, built from the same bindings."""

from __future__ import annotations

from granary import registry as R
from granary.bind import ANSWER_ROWS, STATEMENT_PAGES, TABLE_ROWS
from granary.operators import extraction_prompts, prompts, views
from granary.operators.structure import REASONS

_q = lambda x: "'" + x.replace("'", "''") + "'"
_case = lambda c, of: f"CASE {c} " + " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in of.items()) + " END"
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"

#: Messages of the accounting checks; printf rounds halves to even in binary.
_BALANCE = lambda l, r: f"printf('Year %d: total_assets (%.0f) ≠ total_equity + total_liabilities (%.0f) — relative error %.2f%%', year, {l}, {r}, abs({l} - {r}) / greatest(abs({l}), abs({r}), 1.0) * 100)"
_PROFIT = "printf('Year %d: net_profit (%.0f) exceeds revenue (%.0f) — possible extraction error', year, net_profit, revenue)"

CAND = f"""
cand AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS doc_id, {_list(R.METRIC_NAMES)}[(l_partkey % 17 + 1)::INT] AS metric_name,
         CASE WHEN l_linenumber % 3 = 0 THEN 'Total ' ELSE '' END || replace({_list(R.METRIC_NAMES)}[(l_partkey % 17 + 1)::INT], '_', ' ') AS raw_label,
         CASE WHEN l_discount > 0.08 THEN -l_extendedprice ELSE l_extendedprice END AS value,
         CASE WHEN l_linenumber % 2 = 0 THEN 'INR crores' ELSE 'INR crore' END AS unit, (year(l_shipdate) + 20)::INT AS year, l_linenumber::INT AS page_no,
         {_list(m[1] for m in R.METRICS)}[(l_partkey % 17 + 1)::INT] AS statement_type,
         CASE l_returnflag WHEN 'A' THEN 'standalone' WHEN 'N' THEN 'consolidated' ELSE 'unknown' END AS section_type,
         CASE WHEN l_linestatus = 'F' THEN 'high' ELSE 'low' END AS confidence, CASE WHEN l_tax > 0.04 THEN '{R.TABLE_SOURCE}' ELSE '{R.LINE_SOURCE}' END AS source,
         'order ' || l_orderkey AS evidence, CASE WHEN l_quantity > 25 THEN 'VERIFIED' WHEN l_quantity > 10 THEN 'NEEDS_REVIEW' END AS verification_state,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem)"""

BEST = CAND + f""",
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, metric_name, year ORDER BY
    CASE section_type WHEN 'consolidated' THEN 2 WHEN 'standalone' THEN 0 ELSE 1 END DESC,
    CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC,
    CASE WHEN source = '{R.TABLE_SOURCE}' THEN 1 ELSE 0 END DESC, CASE WHEN lower(raw_label) LIKE 'total %' THEN 1 ELSE 0 END DESC,
    l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn
  FROM cand WHERE year BETWEEN 2000 AND 2100),
best AS (SELECT doc_id, metric_name, value, unit, year, page_no, raw_label, statement_type, section_type, confidence, source, evidence, verification_state FROM ranked WHERE rn = 1)"""

RESOLVED = BEST + f""",
tot AS (
  SELECT doc_id, year, {", ".join(f"max(CASE WHEN metric_name = '{m}' THEN value END) AS {k}" for k, m in (("cl", "current_liabilities"), ("ltd", "long_term_debt"), ("std", "short_term_debt"), ("tl", "total_liabilities"), ("ta", "total_assets"), ("eq", "total_equity")))}
  FROM best GROUP BY doc_id, year),
resolved AS (
  SELECT * FROM best UNION ALL
  SELECT b.doc_id, 'total_liabilities', cl + ltd + coalesce(std, 0), unit, b.year, page_no, 'derived(cl+ltd+std)', 'balance_sheet', section_type, 'derived', '{R.LINE_SOURCE}', evidence, verification_state
  FROM tot t JOIN best b ON b.doc_id = t.doc_id AND b.year = t.year AND b.metric_name = 'current_liabilities' WHERE tl IS NULL AND ltd IS NOT NULL UNION ALL
  SELECT b.doc_id, 'total_assets', eq + tl, unit, b.year, page_no, 'derived(equity+liab)', 'balance_sheet', section_type, 'derived', '{R.LINE_SOURCE}', evidence, verification_state
  FROM tot t JOIN best b ON b.doc_id = t.doc_id AND b.year = t.year AND b.metric_name = 'total_equity' WHERE ta IS NULL AND tl IS NOT NULL)"""

_pick = lambda c, p: ", ".join(f"max(CASE WHEN metric_name = '{m}' THEN {c} END) AS {p}{m}" for m in R.METRIC_NAMES)
WIDE = RESOLVED + f""",
wide AS (
  SELECT doc_id, year, {_pick("value", "")}, {_pick("CASE WHEN section_type NOT IN ('', 'unknown') THEN section_type END", "s_")},
         {_pick("page_no", "p_")}, {_pick("verification_state", "t_")}, {_pick("unit", "u_")}
  FROM resolved GROUP BY doc_id, year)"""

_DEBT = "CASE WHEN long_term_debt IS NOT NULL OR short_term_debt IS NOT NULL THEN coalesce(long_term_debt, 0) + coalesce(short_term_debt, 0) END"


def _v(m: str) -> str:
    return f"({_DEBT})" if m == "total_debt" else m


def _clash(inputs: list[str]) -> str:
    return f"len(list_distinct(list_filter([{', '.join(f's_{m}' for m in inputs)}], lambda x: x IS NOT NULL))) > 1"


def _detail(inputs: list[str]) -> str:
    parts = ", ".join(f"CASE WHEN s_{m} IS NOT NULL THEN '{m}=' || s_{m} END" for m in sorted(inputs))
    return f"array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), ', ')"


def _ratio(name: str, top: str, bottom: str, inputs: list[str]) -> str:
    value = f"{_v(top)} - abs(coalesce({bottom}, 0))" if name == "free_cash_flow" else f"{_v(top)} / nullif({_v(bottom)}, 0)"
    return f"CASE WHEN NOT ({_clash(inputs)}) THEN {value} END"


def _level(risk: str, c: str) -> str:
    _, _, high, medium = next(r for r in R.RISKS if r[0] == risk)
    op = ">" if risk == "debt_risk" else "<"
    return f"CASE WHEN {c} IS NULL THEN 'Unknown' WHEN {c} {op} {high} THEN 'High' WHEN {c} {op} {medium} THEN 'Medium' ELSE 'Low' END"


def _worst_state(states: list[str]) -> str:
    return "CASE " + f"WHEN {' OR '.join(f'coalesce({s}, {chr(39) * 2}) = {chr(39)}NEEDS_REVIEW{chr(39)}' for s in states)} THEN 'NEEDS_REVIEW' " + f"WHEN {' OR '.join(f'coalesce({s}, {chr(39) * 2}) = {chr(39)}VERIFIED{chr(39)}' for s in states)} THEN 'VERIFIED' END"


COMPUTED = WIDE + ",\n" + f"""
rat AS (SELECT *, {_DEBT} AS total_debt, {", ".join(f"{_ratio(*r)} AS {r[0]}" for r in R.RATIOS)},
  {", ".join(f"({m} - lag({m}) OVER w) / nullif(abs(lag({m}) OVER w), 0) AS {n}" for n, m in R.GROWTH)}
  FROM wide WINDOW w AS (PARTITION BY doc_id ORDER BY year)),
computed AS (SELECT *, {", ".join(f"{_level(r, s)} AS {r}" for r, s, *_ in R.RISKS)} FROM rat),
risked AS (SELECT *, ['Unknown', 'Low', 'Medium', 'High'][1 + greatest({", ".join(f"CASE {r} WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END" for r, *_ in R.RISKS)})] AS overall_risk FROM computed)"""

PROVEN = COMPUTED + ",\nproven AS (" + " UNION ALL ".join(
    f"""SELECT doc_id, year, {i} AS seq, '{n}' AS ratio_name, '{t} - abs({b})' AS formula_str, '{t}' AS numerator, '{b}' AS denominator, {_v(t)} AS numerator_val, {_v(b)} AS denominator_val, {n} AS result,
  array_to_string(list_sort(list_distinct(list_filter([{', '.join(f'p_{m}' for m in ins)}], lambda x: x IS NOT NULL))), ',') AS source_pages,
  CASE WHEN {_clash(ins)} THEN 'scope_mismatch: ' || {_detail(ins)} END AS scope_warning,
  CASE WHEN {n} IS NOT NULL THEN {_worst_state([f't_{m}' for m in (t, b) if m != 'total_debt'])} END AS state FROM risked""".replace(f"'{t} - abs({b})'" if n != "free_cash_flow" else "\0", f"'{t} / {b}'")
    for i, (n, t, b, ins) in enumerate(R.RATIOS)
) + ")"

_RATIO_COLUMNS = ["total_debt", *[r[0] for r in R.RATIOS], *[g[0] for g in R.GROWTH]]
_RISK_COLUMNS = [*[r[0] for r in R.RISKS], "overall_risk"]


def _state_of(source: str) -> str:
    r = next((x for x in R.RATIOS if x[0] == source), None)
    if r is None:
        return "t_operating_cash_flow"
    return f"CASE WHEN {source} IS NOT NULL THEN {_worst_state([f't_{m}' for m in r[1:3] if m != 'total_debt'])} END"


RISK_STATES = COMPUTED + f""",
rs AS (SELECT *, {", ".join(f"{_state_of(s)} AS st_{r}" for r, s, *_ in R.RISKS)} FROM risked),
rso AS (SELECT *, {_worst_state([f"st_{r[0]}" for r in R.RISKS])} AS st_overall FROM rs)"""

SQL: dict[str, str] = {
    "valid_years": "WITH c AS (SELECT CAST(l_suppkey AS VARCHAR) AS doc_id, year(l_shipdate)::INT AS year FROM lineitem) SELECT doc_id, year, count(*) AS n FROM c WHERE year BETWEEN 2000 AND 2100 GROUP BY doc_id, year",
    "resolve": f"WITH {RESOLVED} SELECT * FROM resolved",
    "derived_totals": f"WITH {RESOLVED} SELECT doc_id, year, metric_name, value, raw_label, page_no, verification_state FROM resolved WHERE confidence = 'derived'",
    "pivot": f"WITH {WIDE} SELECT doc_id, year, {', '.join(R.METRIC_NAMES)} FROM wide",
    "ratios": f"WITH {COMPUTED} SELECT doc_id, year, {', '.join(_RATIO_COLUMNS)} FROM risked",
    "risks": f"WITH {COMPUTED} SELECT doc_id, year, {', '.join(_RISK_COLUMNS)} FROM risked",
    "provenance": f"WITH {PROVEN} SELECT doc_id, year, ratio_name, formula_str, numerator, denominator, numerator_val, denominator_val, result, source_pages, scope_warning, state FROM proven",
    "ratio_warnings": f"WITH {PROVEN} SELECT doc_id, year, ratio_name || ' (' || year || '): inputs span different reporting scopes (' || substr(scope_warning, 17) || '); ratio suppressed' AS message FROM proven WHERE scope_warning IS NOT NULL UNION ALL SELECT doc_id, year, 'interest_coverage NaN for ' || year || ': interest_expense missing' FROM wide WHERE interest_expense IS NULL",
    "missing_core": f"WITH {WIDE} SELECT doc_id, year, array_to_string(m, ',') AS missing FROM (SELECT doc_id, year, list_filter([{', '.join(f'CASE WHEN {m} IS NULL THEN {chr(39)}{m}{chr(39)} END' for m in R.CORE)}], lambda x: x IS NOT NULL) AS m FROM wide) WHERE len(m) > 0",
    "accounting_checks": f"""WITH {WIDE}, a AS (SELECT doc_id, year, total_assets AS l, total_equity + total_liabilities AS r, revenue, net_profit FROM wide)
SELECT doc_id, year, 1 AS seq, 'balance' AS kind, l AS "left", r AS "right", abs(l - r) / greatest(abs(l), abs(r), 1.0) AS relative_error, {_BALANCE("l", "r")} AS message FROM a WHERE abs(l - r) / greatest(abs(l), abs(r), 1.0) > 0.03
UNION ALL SELECT doc_id, year, 2, 'profit', net_profit, revenue, NULL, {_PROFIT} FROM a WHERE abs(revenue) > 0 AND abs(net_profit) > abs(revenue)""",
    "quality": f"""WITH {WIDE}, c AS (SELECT doc_id, count(*) AS candidate_rows FROM cand GROUP BY doc_id), r AS (SELECT doc_id, count(*) AS resolved_rows FROM resolved GROUP BY doc_id),
m AS (SELECT doc_id, string_agg(year || '=' || array_to_string(l, ','), ';' ORDER BY year) AS missing FROM (SELECT doc_id, year, list_filter([{', '.join(f'CASE WHEN {m} IS NULL THEN {chr(39)}{m}{chr(39)} END' for m in R.CORE)}], lambda x: x IS NOT NULL) AS l FROM wide) WHERE len(l) > 0 GROUP BY doc_id),
i AS (SELECT doc_id, string_agg(message, '|' ORDER BY year, seq) AS issues FROM (SELECT doc_id, year, 1 AS seq, {_BALANCE("total_assets", "(total_equity + total_liabilities)")} AS message FROM wide WHERE abs(total_assets - (total_equity + total_liabilities)) / greatest(abs(total_assets), abs(total_equity + total_liabilities), 1.0) > 0.03
  UNION ALL SELECT doc_id, year, 2, {_PROFIT} FROM wide WHERE abs(revenue) > 0 AND abs(net_profit) > abs(revenue)) GROUP BY doc_id)
SELECT s_suppkey::VARCHAR AS doc_id, coalesce(candidate_rows, 0) AS candidate_rows, coalesce(resolved_rows, 0) AS resolved_rows, m.missing, CASE WHEN candidate_rows IS NULL THEN 'No candidate metrics extracted.' WHEN resolved_rows IS NULL THEN 'All candidates had invalid or missing years.' ELSE coalesce(i.issues, '') END AS issues
FROM supplier LEFT JOIN c ON c.doc_id = s_suppkey::VARCHAR LEFT JOIN r ON r.doc_id = s_suppkey::VARCHAR LEFT JOIN m ON m.doc_id = s_suppkey::VARCHAR LEFT JOIN i ON i.doc_id = s_suppkey::VARCHAR""",
    "ratio_states": f"WITH {PROVEN} SELECT doc_id, year, ratio_name, state FROM proven",
    "risk_view": f"WITH {RISK_STATES} " + " UNION ALL ".join([f"SELECT doc_id, year, '{r.removesuffix('_risk')}' AS risk, {r} AS level, {_q(s) if s in R.RISK_OF_RATIO else 'NULL'} AS ratio_used, {s} AS driver, {_q(R.THRESHOLDS[r])} AS threshold, st_{r} AS state FROM rso" for r, s, *_ in R.RISKS] + ["SELECT doc_id, year, 'overall', overall_risk, NULL, NULL, NULL, st_overall FROM rso"]),
    "explain": f"""WITH {PROVEN}, l AS (SELECT doc_id, max(year) AS year FROM wide GROUP BY doc_id)
SELECT p.doc_id, p.year, p.ratio_name, p.result, formula_str, numerator, denominator, numerator_val, denominator_val, scope_warning, state, source_pages,
 {", ".join(f"{t}.{c} AS {side}_{c}" for t, side in (("n", "numerator"), ("d", "denominator")) for c in ("unit", "page_no", "raw_label", "evidence", "verification_state"))},
 {", ".join(f"NULL AS {side}_{c}" for side in ("numerator", "denominator") for c in ("table_id", "row_index", "col_index"))},
 {_case("p.ratio_name", {k: _q(r.removesuffix("_risk")) for k, r in R.RISK_OF_RATIO.items()})} AS risk_type, {_case("p.ratio_name", {k: _level(r, "p.result") for k, r in R.RISK_OF_RATIO.items()})} AS risk_level, {_case("p.ratio_name", {k: _q(R.THRESHOLDS[r]) for k, r in R.RISK_OF_RATIO.items()})} AS threshold
FROM proven p JOIN l USING (doc_id, year) LEFT JOIN resolved n ON n.doc_id = p.doc_id AND n.year = p.year AND n.metric_name = p.numerator LEFT JOIN resolved d ON d.doc_id = p.doc_id AND d.year = p.year AND d.metric_name = p.denominator""",
    "trust_summary": f"WITH {RESOLVED} SELECT doc_id, count(*) FILTER (verification_state = 'VERIFIED') AS verified, count(*) FILTER (verification_state = 'NEEDS_REVIEW') AS needs_review, count(*) FILTER (verification_state IS NULL) AS unverified FROM resolved GROUP BY doc_id",
    "missing_warning": f"WITH {COMPUTED}, m AS (" + " UNION ALL ".join(f"SELECT doc_id, year, {i} AS i, '{m} not available for ' || year AS t FROM risked WHERE {m} IS NULL" for i, m in enumerate(["current_ratio", "debt_to_equity", "profit_margin", "free_cash_flow", "operating_margin"])) + ") SELECT doc_id, string_agg(t, '; ' ORDER BY year, i) AS warning FROM m GROUP BY doc_id",
    "computed_units": f"""WITH {WIDE}, k AS (SELECT doc_id, year, list_filter([CASE WHEN operating_cash_flow IS NOT NULL THEN u_operating_cash_flow END, CASE WHEN capex IS NOT NULL THEN u_capex END], lambda x: x IS NOT NULL) AS f,
 list_filter([CASE WHEN long_term_debt IS NOT NULL THEN u_long_term_debt END, CASE WHEN short_term_debt IS NOT NULL THEN u_short_term_debt END], lambda x: x IS NOT NULL) AS t FROM wide)
SELECT doc_id, year, CASE WHEN len(list_distinct(list_transform(f, lambda x: regexp_replace(lower(x), 's$', '')))) = 1 THEN f[1] END AS free_cash_flow_unit, CASE WHEN len(list_distinct(list_transform(t, lambda x: regexp_replace(lower(x), 's$', '')))) = 1 THEN t[1] END AS total_debt_unit FROM k""",
    "gold_scores": f"""WITH {RESOLVED}, gold AS (SELECT doc_id, metric_name, year, max(value) AS e FROM cand WHERE metric_name IN ({", ".join(f"'{m}'" for m in R.CORE)}) AND year BETWEEN 2000 AND 2100 GROUP BY ALL),
j AS (SELECT r.value, r.verification_state AS s, coalesce(r.value = e OR abs(e - r.value) / nullif(abs(e), 0) < 0.01, false) AS ok FROM gold LEFT JOIN resolved r USING (doc_id, metric_name, year))
SELECT count(*) AS gold_valid, count(*) FILTER (value IS NOT NULL AND ok AND s = 'VERIFIED') AS verified_correct, count(*) FILTER (value IS NOT NULL AND ok AND coalesce(s, '') <> 'VERIFIED') AS review_correct,
 count(*) FILTER (value IS NOT NULL AND NOT ok AND coalesce(s, '') <> 'VERIFIED') AS review_incorrect, count(*) FILTER (value IS NULL) AS missing, count(*) FILTER (value IS NOT NULL AND NOT ok AND s = 'VERIFIED') AS false_acceptances,
 count(*) FILTER (value IS NOT NULL AND ok) / count(*) AS reviewable_coverage, count(*) FILTER (value IS NOT NULL AND ok AND s = 'VERIFIED') / count(*) AS verified_coverage FROM j""",
    "coverage": f"WITH {CAND}, g AS (SELECT doc_id, count(DISTINCT metric_name) AS found, list_distinct(list(metric_name)) AS has, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (confidence = 'low') AS low FROM cand GROUP BY doc_id), t AS (SELECT l_suppkey::VARCHAR AS doc_id, sum(l_quantity / 8) AS s, count(*) AS n FROM lineitem WHERE l_linenumber % 3 = 0 AND l_suppkey % 7 <> 0 GROUP BY 1) SELECT doc_id, found, round(found * 100.0 / 17, 1)::DOUBLE AS pct, array_to_string(list_filter({_list(R.METRIC_NAMES)}, lambda x: NOT list_contains(has, x)), ',') AS missing, high, medium, low, printf('%.2f', coalesce(s, 0)::DOUBLE)::DOUBLE AS total_latency_s, printf('%.2f', (coalesce(s, 0) / greatest(coalesce(n, 0), 1))::DOUBLE)::DOUBLE AS avg_latency_per_call_s FROM g LEFT JOIN t USING (doc_id)",
    "merge_pages": f"""WITH {CAND}, f AS (SELECT *, first_value(value) OVER w AS fv, first_value(verification_state) OVER w AS fs, row_number() OVER w AS n FROM cand WINDOW w AS (PARTITION BY doc_id, metric_name, year ORDER BY page_no, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, metric_name, year ORDER BY CASE WHEN n > 1 AND (value = fv OR abs(fv - value) / nullif(abs(value), 0) < 0.01) AND verification_state = 'VERIFIED' AND coalesce(fs, '') <> 'VERIFIED' THEN 0 ELSE 1 END, n) AS k FROM f)
SELECT doc_id, metric_name, year, value, verification_state FROM p WHERE k = 1""",
    "answered_pairs": "WITH t AS (SELECT *, lead(role) OVER w AS nx, lag(role) OVER w AS pv FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, role, text FROM t WHERE (role = 'user' AND nx = 'assistant') OR (role = 'assistant' AND pv = 'user')",
    "top_k": "WITH q AS (SELECT vec_id AS query_id, embedding AS qe, label FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, list_sum(list_transform(list_zip(e.embedding, q.qe), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS score FROM embeddings e JOIN q ON q.label = e.label), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, rank, vec_id, round(score, 9) AS score FROM r WHERE rank <= 4",
    "content_gate": "SELECT page_id % 50 AS doc_id, coalesce(bool_or(page_id // 50 < 30 AND (lower(html) LIKE '%table%' OR lower(html) LIKE '%footer%')), false) AS has_content FROM pages GROUP BY 1",
    "upload_gates": """WITH u AS (SELECT CASE WHEN page_id % 3 = 0 THEN url ELSE url || '.pdf' END AS name, (length(html) * 20000)::BIGINT AS size, CASE WHEN page_id % 5 = 0 THEN 'text/html' ELSE 'application/pdf' END AS mime, lower(html) LIKE '%table%' AS ok FROM pages)
SELECT left(md5(name || size), 12) AS doc_id, CASE WHEN lower(name) NOT LIKE '%.pdf' THEN 'INVALID_PDF' WHEN size > 52428800 THEN 'FILE_TOO_LARGE' WHEN mime <> 'application/pdf' THEN 'INVALID_PDF' WHEN NOT ok THEN 'INVALID_PDF' END AS rejected FROM u""",
    "page_offsets": "WITH p AS (SELECT coalesce(source, 'none') || '/' || (doc_id // 400) AS doc_id, (doc_id % 400 + 1)::INT AS page_no, text FROM documents) SELECT doc_id, page_no, coalesce(sum(length(text) + 1) OVER w, 0)::INT AS char_start, (coalesce(sum(length(text) + 1) OVER w, 0) + length(text))::INT AS char_end FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "parse_values": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 4 WHEN 0 THEN -floor(l_extendedprice) WHEN 1 THEN floor(l_extendedprice) WHEN 2 THEN floor(l_extendedprice) END AS value FROM lineitem",
    "header_years": "SELECT o_orderkey, (year(o_orderdate) + 20) || ',' || (year(o_orderdate) + 19) || ',' || (year(o_orderdate) + 18) || ',' || (year(o_orderdate) + 21) AS years FROM orders",
    "column_years": "SELECT o_orderkey, (year(o_orderdate) + 19) || ',' || (year(o_orderdate) + 20) || ',' || (year(o_orderdate) + 21) AS years FROM orders",
    "match_labels": "WITH " + CAND + ", k AS (SELECT DISTINCT raw_label, statement_type, lower(raw_label) AS key FROM cand) SELECT raw_label, statement_type, CASE " + " ".join(
        f"WHEN statement_type = '{st}' AND regexp_matches(key, '{'|'.join(f'(?:{a})' for a in al)}')" + (f" AND NOT regexp_matches(key, '{'|'.join(f'(?:{e})' for e in ex)}')" if ex else "") + f" THEN '{n}'" for n, st, al, ex in R.METRICS) + " END AS metric_name FROM k",
    "text_scan": "SELECT doc_id, len(regexp_extract_all(text, '[0-9]')) AS digits, length(text) AS chars, CASE WHEN lower(text) LIKE '%consolidated%' AND lower(text) NOT LIKE '%standalone%' THEN 'consolidated' WHEN lower(text) LIKE '%standalone%' AND lower(text) NOT LIKE '%consolidated%' THEN 'standalone' ELSE 'unknown' END AS hint FROM documents",
    "answered_calls": """
WITH c AS (SELECT o_orderkey::VARCHAR AS doc_id, ['balance_sheet', 'income_statement', 'cash_flow'][(o_orderkey % 3 + 1)::INT] AS statement_type, o_orderdate::TIMESTAMP AS asked_at FROM orders),
a AS (SELECT l_orderkey::VARCHAR AS doc_id, '{"metrics": [], "value": ' || l_extendedprice || '}' AS raw_json, l_shipdate::TIMESTAMP AS answered_at FROM lineitem WHERE l_linenumber = 1),
w AS (SELECT least((SELECT max(asked_at) FROM c), (SELECT max(answered_at) FROM a)) - INTERVAL 30 DAY AS mark)
SELECT c.*, a.raw_json, a.answered_at FROM c JOIN a ON a.doc_id = c.doc_id AND answered_at BETWEEN asked_at AND asked_at + INTERVAL 1452 HOUR
UNION ALL SELECT c.*, NULL, NULL FROM c, w WHERE asked_at + INTERVAL 1452 HOUR < mark AND NOT EXISTS (FROM a WHERE a.doc_id = c.doc_id AND answered_at BETWEEN asked_at AND asked_at + INTERVAL 1452 HOUR)""",
    "conversation_rows": """
WITH RECURSIVE c AS (SELECT conv_id AS session, turn AS t, role, text, conv_id % 1440 * 60 + turn * 60 + CASE WHEN conv_id % 5 = 0 AND turn >= 4 THEN 7200 ELSE 0 END AS s, conv_id % 7 = 3 AND turn % 4 = 1 AS fails, CASE WHEN conv_id % 3 = 1 THEN 130 ELSE 0 END AS late FROM conversations),
raw AS (
  SELECT session, s, t * 10 AS seq, 'reset' AS kind, NULL::BIGINT AS request, '' AS text FROM c WHERE role = 'system'
  UNION ALL SELECT session, s, t * 10 + 1, 'ask', t, trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') FROM c WHERE role = 'user'
  UNION ALL SELECT session, s + 5, t * 10 + 2, 'reset', NULL, '' FROM c WHERE role = 'user' AND (session + t) % 6 = 4
  UNION ALL SELECT session, s + late, t * 10 + 3, 'reply', t - 1, text FROM c WHERE role = 'assistant' AND NOT fails
  UNION ALL SELECT session, s, t * 10 + 4, 'fail', t - 1, 'no answer' FROM c WHERE role = 'assistant' AND fails
  UNION ALL SELECT session, s + 10, t * 10 + 5, 'retry', t + 100, '' FROM c WHERE role = 'assistant' AND fails
  UNION ALL SELECT session, s + 20, t * 10 + 6, 'reply', t + 100, text FROM c WHERE role = 'assistant' AND fails),
ev AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY s, seq) AS i, max(s) OVER () AS newest FROM raw),
st AS (
  SELECT DISTINCT session, 0::BIGINT AS i, 0::BIGINT AS generation, NULL::BIGINT AS asked, []::STRUCT(role VARCHAR, text VARCHAR)[] AS log, 0::BIGINT AS s, 0::BIGINT AS seq, '' AS outcome, NULL::STRUCT(role VARCHAR, text VARCHAR)[] AS history,
         false AS forgot, 0::BIGINT AS old_seq, 0::BIGINT AS old_generation, 0::BIGINT AS old_messages FROM ev
  UNION ALL
  SELECT session, i, generation + (kind = 'reset')::INT, CASE outcome WHEN 'reset' THEN NULL WHEN 'answered' THEN NULL WHEN 'failed' THEN NULL WHEN 'asked' THEN request ELSE asked END,
         CASE outcome WHEN 'reset' THEN [] WHEN 'answered' THEN list_append(log, {'role': 'assistant', 'text': text}) WHEN 'failed' THEN list_append(log, {'role': 'error', 'text': text})
           WHEN 'asked' THEN list_append(base, {'role': 'user', 'text': CASE kind WHEN 'retry' THEN log[len(log) - 1].text ELSE text END}) ELSE log END,
         s, seq, outcome, CASE WHEN outcome = 'asked' THEN list_filter(base, lambda m, k: m.role = 'assistant' OR (m.role = 'user' AND coalesce(base[k + 1].role, '') = 'assistant')) END,
         forgot, old_seq, old_generation, old_messages
  FROM (
    SELECT *, CASE kind WHEN 'retry' THEN log[1:greatest(len(log) - 2, 0)] ELSE log END AS base,
           CASE WHEN kind = 'reset' THEN 'reset' WHEN kind IN ('reply', 'fail') THEN CASE WHEN asked = request THEN CASE kind WHEN 'reply' THEN 'answered' ELSE 'failed' END ELSE 'stale' END
             WHEN asked IS NOT NULL THEN 'ignored' WHEN kind = 'ask' AND text <> '' THEN 'asked'
             WHEN kind = 'retry' AND len(log) >= 2 AND log[len(log)].role = 'error' AND log[len(log) - 1].role = 'user' THEN 'asked' ELSE 'ignored' END AS outcome
    FROM (
      SELECT ev.session, ev.i, ev.kind, ev.request, ev.text, ev.s, ev.seq, st.i > 0 AND ev.s >= st.s + 1807 AS forgot, st.seq AS old_seq, st.generation AS old_generation, len(st.log) AS old_messages,
             CASE WHEN st.i > 0 AND ev.s >= st.s + 1807 THEN 0 ELSE st.generation END AS generation, CASE WHEN st.i > 0 AND ev.s >= st.s + 1807 THEN NULL ELSE st.asked END AS asked,
             CASE WHEN st.i > 0 AND ev.s >= st.s + 1807 THEN [] ELSE st.log END AS log
      FROM st JOIN ev ON ev.session = st.session AND ev.i = st.i + 1))),
ended AS (SELECT st.*, newest FROM st JOIN (SELECT session, max(i) AS i, any_value(newest) AS newest FROM ev GROUP BY session) USING (session, i))
SELECT session, seq, outcome, generation, len(log)::INT AS messages, len(history)::INT AS told, md5(array_to_string(list_transform(history, lambda m: m.role || ':' || m.text), '|')) AS history FROM st WHERE i > 0
UNION ALL SELECT session, old_seq, 'expired', old_generation, old_messages::INT, NULL, NULL FROM st WHERE forgot
UNION ALL SELECT session, seq, 'expired', generation, len(log)::INT, NULL, NULL FROM ended WHERE s + 1807 <= newest - 600""",
    "stream_windows": "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}

_page = lambda f: "[" + ", ".join(f(p) for p in STATEMENT_PAGES) + "][l_linenumber::INT]"
_money = lambda c: f"format('{{:,.2f}}', {c})"
LINES = f"""
sl0 AS (
  SELECT l_suppkey, CAST(l_suppkey AS VARCHAR) AS doc_id, l_linenumber::INT AS page_no, {_page(lambda p: _q(p[0]))} AS statement_type, {_page(lambda p: _q(p[1]))} AS title,
         {_page(lambda p: _list(m for m, _ in p[2]))} AS ms, {_page(lambda p: _list(m for _, m in p[2]))} AS ls, l_partkey,
         round(l_extendedprice + 10000, 2) AS v1, round(l_quantity * 100 + 10000 + l_discount, 2) AS v2, (l_suppkey % 12 + 2010)::INT AS year,
         row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax)::INT AS pos
  FROM lineitem WHERE l_linenumber <= 3),
sl AS (SELECT *, ms[(l_partkey % len(ms))::INT + 1] AS metric_name, ls[(l_partkey % len(ms))::INT + 1] AS label, ls[(l_partkey % len(ms))::INT + 1] || ' ' || {_money("v1")} || ' ' || {_money("v2")} AS line FROM sl0)"""

PAGES = LINES + """,
sp AS (
  SELECT doc_id, page_no, title || chr(10) || 'Consolidated as at 31 March ' || year || ' and 31 March ' || (year - 1) || ' (₹ in crore)' || chr(10) || 'Supplier#' || lpad(doc_id, 9, '0') || ' Limited' || chr(10) || string_agg(line, chr(10) ORDER BY pos) AS text,
         statement_type, 2 * count(*) AS numbers, count(*) + 3 AS n_lines, count(*) FILTER (label LIKE 'Total%') AS totals
  FROM sl GROUP BY doc_id, page_no, title, statement_type, year UNION ALL
  SELECT CAST(l_suppkey AS VARCHAR), l_linenumber::INT, CASE WHEN l_linenumber % 2 = 0 THEN 'Notes to the accounts' ELSE 'Management discussion' END || chr(10) || 'Orders met: ' || count(*), CASE WHEN l_linenumber % 2 = 0 THEN 'notes' ELSE 'mda' END, 0, 2, 0
  FROM lineitem WHERE l_linenumber > 3 GROUP BY l_suppkey, l_linenumber)"""

_said = lambda t: " + ".join(f"contains(lower(text), {_q(w)})::INT" for w in R.CHECKLIST[t])
CLASSES = PAGES + f""",
sc AS (SELECT *, page_no <= 3 AND numbers >= 5 AS dense FROM sp),
cl AS (SELECT doc_id, page_no, CASE WHEN dense OR page_no > 3 THEN statement_type ELSE 'other' END AS statement_type, CASE WHEN page_no <= 3 THEN 'consolidated' ELSE 'unknown' END AS section_type,
  CASE WHEN dense THEN 3.0::DOUBLE * 2 + 4.0::DOUBLE * (least(numbers, 20)::DOUBLE / 20) + 3.0::DOUBLE * (least(totals, 8)::DOUBLE / 8) + 2.0::DOUBLE * ({_case("statement_type", {t: f"({_said(t)})::DOUBLE / {float(len(R.CHECKLIST[t]))}::DOUBLE" for t in R.STATEMENTS})}) + 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, numbers::INT AS numeric_count FROM sc),
chosen AS (SELECT doc_id, statement_type, 0 AS ord, page_no FROM cl WHERE page_no <= 3 AND statement_type <> 'other' UNION ALL SELECT doc_id, statement_type, 1, 4 FROM cl WHERE page_no = 3 AND statement_type = 'cash_flow'),
blocks AS (SELECT c.doc_id, c.statement_type, left(string_agg(chr(10) || '--- Page ' || c.page_no || ' ---' || chr(10) || text, '' ORDER BY ord), 10000) AS block FROM chosen c JOIN sp USING (doc_id, page_no) GROUP BY c.doc_id, c.statement_type)"""

_ask = lambda t: extraction_prompts.ASK.format(statement=t, names=", ".join(m for m, own, *_ in R.METRICS if own == t), hints=f"\n\n{extraction_prompts.HINTS}{extraction_prompts.label_hints(t)}")
_reason = lambda what, x: _q(f"{what}:fragment_not_found_in_order: {x!r}")

CELLS = LINES + f""",
tl AS (SELECT *, pos - 1 AS row_index FROM sl WHERE pos <= {TABLE_ROWS}),
cells AS (SELECT doc_id, statement_type AS call, row_index, 1 AS col_index, v1 AS v, year AS y FROM tl UNION ALL SELECT doc_id, statement_type, row_index, 2, v2, year - 1 FROM tl),
cc AS (SELECT doc_id, statement_type AS call, pos AS seq, metric_name, CASE WHEN pos % 4 = 3 THEN 'no such label' ELSE lower(label) END AS label, CASE WHEN pos % 4 = 2 THEN v1 + 777777 ELSE v1 END AS value, CASE WHEN pos % 4 = 1 THEN year - 1 ELSE year END AS year, row_index FROM tl),
hits AS (SELECT c.doc_id, c.call, c.seq, x.row_index, x.col_index, x.y, CASE WHEN x.y = c.year THEN 0 ELSE 1 END AS kind, row_number() OVER (PARTITION BY c.doc_id, c.call, c.seq ORDER BY CASE WHEN x.y = c.year THEN 0 ELSE 1 END, x.row_index, x.col_index) AS rn, count(*) FILTER (x.y = c.year) OVER (PARTITION BY c.doc_id, c.call, c.seq) AS clean
  FROM cc c JOIN cells x ON x.doc_id = c.doc_id AND x.call = c.call AND x.v - c.value < 0.005 AND c.value - x.v < 0.005),
lab AS (SELECT doc_id, statement_type AS call, lower(label) AS label, min(row_index) AS lrow FROM tl GROUP BY ALL),
rv AS (SELECT doc_id, statement_type AS call, metric_name, list(row_index ORDER BY row_index) AS rivals FROM tl GROUP BY ALL),
j AS (SELECT c.*, h.row_index AS r, h.col_index AS k, h.kind, h.clean, h.y, l.lrow, t.v AS truth, t.col_index AS tcol, rv.rivals, hl.metric_name = c.metric_name AND len(rv.rivals) > 1 AS own, [1, 2, 3][list_position({_list(p[0] for p in STATEMENT_PAGES)}, c.call)] || '_t0' AS tid
  FROM cc c LEFT JOIN hits h ON h.doc_id = c.doc_id AND h.call = c.call AND h.seq = c.seq AND h.rn = 1 LEFT JOIN lab l ON l.doc_id = c.doc_id AND l.call = c.call AND l.label = c.label
  LEFT JOIN cells t ON t.doc_id = c.doc_id AND t.call = c.call AND t.row_index = l.lrow AND t.y = c.year LEFT JOIN rv ON rv.doc_id = c.doc_id AND rv.call = c.call AND rv.metric_name = c.metric_name LEFT JOIN tl hl ON hl.doc_id = c.doc_id AND hl.statement_type = c.call AND hl.row_index = h.row_index),
verdicts AS (SELECT *, CASE WHEN r IS NULL AND truth IS NOT NULL AND abs(truth - value) >= 0.005 THEN 'contradiction' WHEN r IS NULL THEN 'not found' WHEN kind = 1 THEN 'other year' WHEN clean > 1 THEN 'several' WHEN lrow <> r THEN 'other row' WHEN own AND r <> rivals[-1] THEN 'subtotal' WHEN own THEN 'final' ELSE 'sole' END AS name FROM j)"""

SQL |= {
    "statement_classes": f"WITH {CLASSES} SELECT * FROM cl",
    "statement_selection": f"WITH {CLASSES} SELECT * FROM chosen",
    "statement_blocks": f"WITH {CLASSES} SELECT * FROM blocks",
    "extraction_prompts": f"WITH {CLASSES} SELECT doc_id, statement_type, {_case('statement_type', {t: _q(extraction_prompts.system_prompt(t)) for t in R.STATEMENTS})} AS system, {_case('statement_type', {t: _q(_ask(t)) for t in R.STATEMENTS})} || block || {_q(extraction_prompts.END)} AS prompt FROM blocks",
    "header_page_years": f"WITH {PAGES} SELECT doc_id, string_agg(DISTINCT y, ',' ORDER BY y DESC) AS years FROM (SELECT doc_id, unnest([year, year - 1])::VARCHAR AS y FROM sl WHERE page_no <= 3) GROUP BY doc_id",
    "company_names": f"WITH {LINES} SELECT DISTINCT doc_id, 'Supplier#' || lpad(doc_id, 9, '0') || ' Limited' AS company_name FROM sl",
    "narrative_pages": f"WITH {CLASSES} SELECT doc_id, page_no, statement_type FROM cl WHERE statement_type NOT IN ('balance_sheet', 'income_statement', 'cash_flow')",
    "tagged_tables": f"WITH {CLASSES} SELECT DISTINCT t.doc_id, t.page_no, cl.statement_type, cl.section_type AS section_hint FROM sl t JOIN cl USING (doc_id, page_no)",
    "line_candidates": f"""WITH {CLASSES}, k AS (SELECT s.doc_id, s.page_no, s.statement_type, s.metric_name, s.label, unnest([{{'i': 0, 'v': v1, 'y': year}}, {{'i': 1, 'v': v2, 'y': year - 1}}]) AS x, pos FROM sl s JOIN cl USING (doc_id, page_no) WHERE cl.statement_type = s.statement_type)
SELECT doc_id, page_no, statement_type, metric_name, label AS raw_label, x.v AS value, x.y::INT AS year, 'crore' AS unit, 'consolidated' AS section_type, 'low' AS confidence, ((page_no::BIGINT * 1000000 + pos + 2) * 100) * 10 + x.i AS seq FROM k""",
    "table_candidates": f"""WITH {CLASSES}, k AS (SELECT s.doc_id, s.page_no, s.statement_type, s.metric_name, s.label, unnest([{{'c': 1, 'v': v1, 'y': year}}, {{'c': 2, 'v': v2, 'y': year - 1}}]) AS x, pos FROM sl s JOIN cl USING (doc_id, page_no) WHERE cl.statement_type = s.statement_type AND pos <= {TABLE_ROWS})
SELECT doc_id, page_no, statement_type, metric_name, label AS raw_label, x.v AS value, x.y::INT AS year, 'crore' AS unit, 'consolidated' AS section_type, 'high' AS confidence, pos::BIGINT * 1000 + x.c AS seq FROM k""",
    "answer_candidates": f"""WITH {LINES} SELECT doc_id, page_no, statement_type, metric_name, label AS raw_label, v1 AS value, 'INR crore' AS unit, year, ['high', 'medium', 'low', 'low'][pos % 4 + 1] AS confidence, CASE WHEN page_no = 2 THEN 'standalone' ELSE 'consolidated' END AS section_type, line AS evidence,
 (row_number() OVER (PARTITION BY doc_id, page_no ORDER BY pos) - 1)::BIGINT AS seq FROM sl WHERE pos <= {ANSWER_ROWS}""",
    "grounded": f"""WITH {CLASSES}, w AS (SELECT *, min(pos) OVER (PARTITION BY doc_id, page_no, label) AS lead, lag(v1) OVER p AS p1, lag(v2) OVER p AS p2 FROM sl WINDOW p AS (PARTITION BY doc_id, page_no ORDER BY pos)),
-- the 40 characters behind a label's first place hold its own line's figures, and those of the next line if they are short
f AS (SELECT *, coalesce(lead = pos OR (lead = pos - 1 AND 4 + length(printf('%.2f', p1)) + length(printf('%.2f', p2)) + length(label) + length(regexp_replace(printf('%.2f', v1), '\\.?0+$', '')) <= 40), false) AS head FROM w)
SELECT f.doc_id, f.page_no, f.pos, pos % 6 <> 2 AS l2_passed, pos % 6 <> 2 AS l3_passed, pos % 6 <> 3 AS l4_passed, pos % 6 NOT IN (1, 3, 4) AS l5_passed, pos % 6 = 3 AS l5_degraded,
 CASE pos % 6 WHEN 1 THEN 'value_not_grounded:value_not_grounded' WHEN 2 THEN 'raw_label_mismatch; ' || {_reason("raw_label_not_grounded", "unheard caption")} WHEN 3 THEN {_reason("evidence_not_grounded", "absent words")} WHEN 4 THEN 'value_not_grounded:' || CASE WHEN head THEN 'sign_mismatch' ELSE 'value_not_grounded' END ELSE '' END AS rejection_reasons
FROM f JOIN blocks b ON b.doc_id = f.doc_id AND b.statement_type = f.statement_type""",
    "table_cells": f"WITH {CELLS} SELECT doc_id, call, row_index, col_index, v AS cell_value, y AS year FROM cells",
    "structural": f"""WITH {CELLS} SELECT doc_id, call, seq, {_case("name", {n: _q(state) for n, (state, _) in REASONS.items()})} AS verification_state,
 CASE name WHEN 'contradiction' THEN 'structural contradiction: row ' || lrow || ' (label matches raw_label verbatim), column for ' || year || ' contains ' || truth || ', not the declared value ' || value
  WHEN 'not found' THEN 'declared value ' || value || ' not found in any structural table cell on this page' WHEN 'other year' THEN 'value found at row ' || r || ' but in the ' || y || ' column, not the declared ' || year || ' column'
  WHEN 'several' THEN 'declared value+year combination matches ' || clean || ' structurally distinct rows on this page -- not uniquely identifiable'
  WHEN 'other row' THEN 'declared raw_label matches row ' || lrow || ', but the declared value+year matches a different row (' || r || ') -- label/value row mismatch'
  WHEN 'subtotal' THEN 'row ' || r || chr(39) || 's label matches ' || metric_name || ', but ' || len(rivals) || ' rows on this page do (rows [' || array_to_string(rivals, ', ') || ']) -- row ' || r || ' is not the last (most likely final-total) of them; likely an intermediate subtotal'
  ELSE 'row ' || r || ' uniquely identified by value+year; column matches declared year ' || year || CASE name WHEN 'final' THEN '; positionally final among ' || len(rivals) || ' candidate rows for this metric' ELSE '' END END AS verification_reason,
 CASE name WHEN 'not found' THEN NULL WHEN 'several' THEN NULL ELSE tid END AS table_id, CASE name WHEN 'contradiction' THEN lrow WHEN 'not found' THEN NULL WHEN 'several' THEN NULL ELSE r END AS row_index, CASE name WHEN 'contradiction' THEN tcol WHEN 'not found' THEN NULL WHEN 'several' THEN NULL ELSE k END AS col_index FROM verdicts""",
    "metrics_view": f"""WITH {RESOLVED}, m AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS metrics FROM (SELECT doc_id, concat_ws(':', year::VARCHAR, metric_name, printf('%.2f', value), unit, page_no::VARCHAR, raw_label, section_type, confidence, evidence, verification_state) AS x FROM resolved) GROUP BY doc_id)
SELECT s_suppkey::VARCHAR AS doc_id, s_name AS company_name, CASE WHEN s_suppkey % 5 > 1 THEN (s_suppkey % 12 + 2010) || ',' || (s_suppkey % 12 + 2009) ELSE '' END AS document_years, coalesce(n, 0) AS n, coalesce(metrics, '') AS metrics FROM supplier LEFT JOIN m ON m.doc_id = s_suppkey::VARCHAR""",
    "ratio_view": f"WITH {PROVEN}, st AS (SELECT doc_id, year, string_agg(ratio_name || '=' || coalesce(state, '-'), ',' ORDER BY ratio_name) AS states FROM proven GROUP BY doc_id, year) SELECT r.doc_id, r.year, {', '.join(views.VIEW_RATIOS)}, states FROM risked r JOIN st USING (doc_id, year)",
    "metric_at": f"WITH {RESOLVED} SELECT r.doc_id, metric_name, year, value FROM resolved r JOIN (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS doc_id, {_list(R.METRIC_NAMES)}[(l_partkey % 17 + 1)::INT] AS metric_name, (year(l_shipdate) + 21)::INT AS year FROM lineitem) w USING (doc_id, metric_name, year) WHERE value IS NOT NULL",
    "years_of": f"WITH {RESOLVED} SELECT doc_id, string_agg(DISTINCT year::VARCHAR, ',' ORDER BY year::VARCHAR) AS years FROM resolved GROUP BY doc_id",
    "document_guard": "SELECT k::VARCHAR AS doc_id, s_suppkey IS NOT NULL AND s_suppkey % 3 = 0 AS ready, CASE WHEN s_suppkey IS NULL THEN 'DOC_NOT_FOUND' WHEN s_suppkey % 3 = 1 THEN 'DOC_PROCESSING' WHEN s_suppkey % 3 = 2 THEN 'DOC_FAILED' END AS error_code FROM (SELECT c_custkey AS k FROM customer) LEFT JOIN supplier ON s_suppkey = k",
    "sources": """WITH r AS (SELECT conv_id, turn, turn % 3 + 1 AS page_no, role, left(coalesce(text, ''), 200) AS snip FROM conversations),
a AS (SELECT conv_id, page_no, min(turn) + 1 AS first FROM r GROUP BY ALL), b AS (SELECT conv_id, page_no, count(*) AS snippets FROM (SELECT DISTINCT conv_id, page_no, snip FROM r) GROUP BY ALL),
c AS (SELECT conv_id, page_no, string_agg(role, ',' ORDER BY head) AS sections FROM (SELECT conv_id, page_no, role, min(turn) AS head FROM r GROUP BY ALL) GROUP BY ALL)
SELECT conv_id AS query_id, a.page_no::INT AS page_no, (row_number() OVER (PARTITION BY conv_id ORDER BY a.first))::INT AS place, c.sections, b.snippets::INT AS snippets FROM a JOIN b USING (conv_id, page_no) JOIN c USING (conv_id, page_no)""",
    "mentions": f"""WITH {COMPUTED}, q AS (SELECT conv_id || '/' || turn AS query_id, CAST(conv_id + 1 AS VARCHAR) AS doc_id, lower(coalesce(text, '') || ' What of ' || {_list(p for p, _ in [*views.RATIO_PHRASES, *views.METRIC_PHRASES])}[((conv_id * 8 + turn) % {len([*views.RATIO_PHRASES, *views.METRIC_PHRASES])} + 1)::INT] || '? ' || coalesce(text, '')) AS said FROM conversations),
p AS (SELECT DISTINCT query_id, doc_id, m FROM q JOIN (VALUES {", ".join(f"({_q(a)}, {_q(b)})" for a, b in views.RATIO_PHRASES)}) t(phrase, m) ON contains(said, phrase)), pm AS (SELECT DISTINCT query_id, doc_id, m FROM q JOIN (VALUES {", ".join(f"({_q(a)}, {_q(b)})" for a, b in views.METRIC_PHRASES)}) t(phrase, m) ON contains(said, phrase)),
long AS ({" UNION ALL ".join(f"SELECT doc_id, year, {_q(m)} AS m, {m} AS value FROM risked" for m in sorted({m for _, m in views.RATIO_PHRASES}))})
SELECT query_id, m AS metric, year, value FROM p JOIN long USING (doc_id, m) UNION ALL SELECT query_id, m, year, value FROM pm JOIN resolved r ON r.doc_id = pm.doc_id AND r.metric_name = pm.m""",
    "scope_tags": f"WITH {RESOLVED} SELECT doc_id, metric_name, year, CASE section_type WHEN 'consolidated' THEN '[consolidated]' WHEN 'standalone' THEN '[standalone]' ELSE '[scope not verified]' END AS scope, list_aggregate(list_transform(string_split(metric_name, '_'), lambda w: upper(w[1]) || substr(w, 2)), 'string_agg', ' ') AS title FROM resolved",
    "classify_pages": r"""WITH p AS (SELECT coalesce(source, 'none') || '/' || (doc_id // 400) AS doc_id, (doc_id % 400 + 1)::INT AS page_no, coalesce(text, '') AS text FROM documents)
SELECT doc_id, page_no, CASE """ + " ".join("WHEN " + " OR ".join(f"contains(lower(text), {_q(w)})" for w in words) + f" THEN {_q(k)}" for k, words in R.NARRATIVE) + r""" ELSE 'other' END AS statement_type,
 CASE WHEN regexp_matches(array_to_string(string_split(text, chr(10))[1:3], chr(10)), '(?i)\bconsolidated\b') THEN 'consolidated' WHEN regexp_matches(array_to_string(string_split(text, chr(10))[1:3], chr(10)), '(?i)\bstandalone\b') THEN 'standalone' ELSE 'unknown' END AS section_type,
 0.0::DOUBLE AS score, len(list_filter(regexp_extract_all(text, '(?:[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]{1,2})?|[0-9]+\.[0-9]{2})(?:\s*%)?'), lambda x: contains(x, ',') OR NOT contains(x, '%')))::INT AS numeric_count FROM p""",
    "metric_lines": f"""WITH {RESOLVED}, k(metric_name, g, i, label) AS (VALUES {", ".join(f"({_q(m)}, {g}, {i}, {_q(label)})" for g, (_, ms) in enumerate(prompts.GROUPS) for i, (m, label) in enumerate(ms))}),
l AS (SELECT doc_id, g, i, year, '  ' || label || ' (' || year || '): ' || {_money("value")} || CASE WHEN coalesce(unit, '') <> '' THEN ' ' || unit ELSE '' END || CASE WHEN page_no IS NOT NULL THEN ' (page ' || page_no || ')' ELSE '' END || ' ' || CASE section_type WHEN 'consolidated' THEN '[consolidated]' WHEN 'standalone' THEN '[standalone]' ELSE '[scope not verified]' END
  || CASE WHEN verification_state = 'NEEDS_REVIEW' THEN ' [NEEDS_REVIEW: None]' ELSE '' END AS line FROM resolved JOIN k USING (metric_name) WHERE year IS NOT NULL AND value IS NOT NULL),
t AS (SELECT doc_id, g, {_list(n for n, _ in prompts.GROUPS)}[g + 1] || ':' || chr(10) || string_agg(line, chr(10) ORDER BY i, year) AS text FROM l GROUP BY doc_id, g)
SELECT doc_id, string_agg(text, chr(10) ORDER BY g) AS resolved_section FROM t GROUP BY doc_id""",
    "chunk_locations": f"""WITH {CLASSES}, np AS (SELECT sp.doc_id, sp.page_no, sp.text, cl.statement_type AS kind, coalesce(sum(length(text) + 1) OVER (PARTITION BY sp.doc_id ORDER BY sp.page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS pos FROM sp JOIN cl USING (doc_id, page_no) WHERE page_no > 3),
parts AS (SELECT doc_id, unnest(range(0, n + 1, 25))::INT AS pos FROM (SELECT doc_id, max(pos + length(text)) AS n FROM np GROUP BY doc_id)),
heads AS (SELECT doc_id, pos, split_part(text, chr(10), 1) AS title FROM np UNION ALL SELECT doc_id, (pos + length(split_part(text, chr(10), 1)) + 1)::INT, split_part(text, chr(10), 2) FROM np)
SELECT c.doc_id || '_' || p.page_no || '_' || (c.pos // 25) AS chunk_id, c.doc_id, p.page_no, h.title AS section_title, p.kind AS section_type, c.pos AS char_start, c.pos + 25 AS char_end
FROM parts c ASOF JOIN np p ON p.doc_id = c.doc_id AND p.pos <= c.pos ASOF JOIN heads h ON h.doc_id = c.doc_id AND h.pos <= c.pos""",
    "text_forms": r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), t AS (SELECT doc_id, trim(line) AS s FROM l WHERE length(trim(line)) > 0),
f AS (SELECT doc_id, s, trim(regexp_replace(lower(s), '\s+', ' ', 'g')) AS k, length(s) <= 120 AND len(regexp_split_to_array(s, '\s+')) <= 14 AND len(regexp_extract_all(s, '[0-9]')) <= length(s) * 0.3 AND (regexp_matches(s, '^\p{Lu}') OR (upper(s) = s AND lower(s) <> s)) AS heading FROM t)
SELECT doc_id, count(*) AS n, count(*) FILTER (heading) AS headings, md5(string_agg(k, '|' ORDER BY k)) AS row_keys, md5(string_agg(regexp_replace(regexp_replace(k, '([0-9]),([0-9])', '\1\2', 'g'), '([0-9]),([0-9])', '\1\2', 'g'), '|' ORDER BY k)) AS grounding_keys,
 md5(string_agg(trim(regexp_replace(regexp_replace(regexp_replace(k, '\[[^\]]+\]', '', 'g'), '^[()ivxabc0-9]+[.)\s]\s*', ''), '\s+', ' ', 'g')), '|' ORDER BY k)) AS labels FROM f GROUP BY doc_id""",
}
SQL |= {"top_k_search": SQL["top_k"], "select_pages": SQL["statement_selection"]}
