"""Prompts that ask a model for the metrics of a statement's pages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary import registry as R

# What the model is told, word for word.
ANSWER_FORM = """\
Output schema:
{
  "metrics": [
    {
      "canonical_name": "<name from canonical list>",
      "raw_label": "<copied verbatim, character-for-character, from the DOCUMENT TEXT below -- NEVER from the canonical name list or the label-variant hints, even if one of them looks similar>",
      "value": <float or null>,
      "unit": "<INR Crore / INR Lakh / USD Million / etc>",
      "year": <integer YYYY or null>,
      "confidence": "<high|medium|low>",
      "section_type": "<consolidated|standalone|unknown>",
      "evidence": "<verbatim line(s) from text where value was found>"
    }
  ],
  "notes": "<any important observations about the data>"
}

Confidence guide:
- high: label clearly matches, value is unambiguous, year is clear
- medium: label is close but not exact, or year required inference
- low: value or label was ambiguous

Worked example -- a single line item with two years MUST become TWO entries:
Source text:
  "Revenue from operations
  17
  68,468
  63,730"
(17 is a note reference -- skip it, per rule 10. 68,468 is the first/most
recent year's value, 63,730 is the prior year's value. BOTH are present and
BOTH must be extracted, as two separate objects in "metrics", same
canonical_name and raw_label, different year and value each:)
{
  "metrics": [
    {
      "canonical_name": "revenue",
      "raw_label": "Revenue from operations",
      "value": 68468,
      "unit": "INR million",
      "year": 2025,
      "confidence": "high",
      "section_type": "consolidated",
      "evidence": "Revenue from operations\\n17\\n68,468\\n63,730"
    },
    {
      "canonical_name": "revenue",
      "raw_label": "Revenue from operations",
      "value": 63730,
      "unit": "INR million",
      "year": 2024,
      "confidence": "high",
      "section_type": "consolidated",
      "evidence": "Revenue from operations\\n17\\n68,468\\n63,730"
    }
  ]
}
Never emit only the first of these two objects and omit the second -- a
two-column comparative row always requires two output objects, one per year."""

RULES = """\
You are a financial data extraction engine for Indian annual reports.

Rules:
1. Extract ONLY values that are explicitly present in the provided text.
2. Do NOT calculate, infer, or guess any value.
3. Numbers may use Indian formatting: 1,89,483 means 189483. Convert to plain float.
4. Negative values are shown in parentheses: (4,521) = -4521.
5. Dashes (—, -) in value cells mean zero or not applicable; use null.
6. Map each extracted item to the closest canonical_name from the list provided.
7. IMPORTANT -- Multi-year rows: if a line item's row shows values for more than
   one year (a comparative table, e.g. "current year" and "prior year" side by
   side), you MUST output EVERY one of those years as its own SEPARATE entry in
   the "metrics" array -- never only the first, most recent, or left-most one.
   Each such entry shares the same canonical_name and raw_label but has its own
   year and its own value. A row with two year columns always produces TWO
   metrics entries, never one. See the worked example below the output schema.
8. Output ONLY a valid JSON object. No explanation text outside the JSON.
9. Keep evidence snippets under 100 characters.
10. IMPORTANT — Note reference numbers: Indian financial statements include a
    "Notes" column. Note references are small standalone integers (1–50) that
    appear on their own line immediately after a row label and immediately before
    the actual financial values.
    Example: "Revenue from operations\\n17\\n68,468\\n63,730" — here 17 is the
    note reference, NOT the revenue value. Revenue values are 68,468 and 63,730.
    Rule: if you see a standalone integer ≤ 50 between a label and large
    comma-formatted numbers, skip it entirely."""

BALANCE_SHEET_RULES = """\
11. IMPORTANT — Indian Balance Sheet TOTAL rows: The word "TOTAL" appears TWICE.
    The first TOTAL = Total Assets (sum of all assets).
    The second TOTAL = Total Equity + Liabilities (balance check, same numeric value).
    Rules:
    - Extract total_assets ONLY from the first TOTAL (under the ASSETS section).
    - Do NOT use the second TOTAL for total_assets, total_liabilities, or
      current_liabilities. The second TOTAL is a balance check, not a liability.
12. IMPORTANT — total_liabilities has NO explicit label in Indian balance sheets.
    To derive it: find the standalone subtotal at the END of the liabilities section
    (after all liability line items), BEFORE the second TOTAL row.
    This subtotal = non-current liabilities subtotal + current liabilities subtotal.
    Example: non-current liabilities subtotal 6,217 + current liabilities subtotal
    11,509 → total_liabilities = 17,726.
    DO NOT use the second TOTAL row value for total_liabilities.
13. IMPORTANT — current_liabilities: find the standalone subtotal at the END of the
    "Current liabilities" section — a plain number on its own line before the TOTAL row.
    Do NOT use the TOTAL row value for current_liabilities."""

CASH_FLOW_RULES = """\
11. IMPORTANT — Cash flow label disambiguation:
    "Cash from operating activities" (or "Cash generated from operations") is a
    PRE-TAX subtotal that appears in the MIDDLE of the operating activities section.
    Do NOT extract it as operating_cash_flow.
    operating_cash_flow must be the line labeled "Net cash provided by operating
    activities" or "Net cash from operating activities" — this appears AFTER the
    tax paid line item near the END of the operating section.
    Apply the same rule for investing_cash_flow and financing_cash_flow: extract only
    the final "Net cash from/used in X activities" totals, not intermediate subtotals."""

HINTS = "Common label variants for some metrics (for matching only — always use the canonical_name from the list above, never a variant):\n"
ASK = "Statement type: {statement}\n\nCanonical metric names you may use (use ONLY these):\n{names}{hints}\n\n--- DOCUMENT TEXT ---\n"
END = "\n--- END OF TEXT ---\n\nExtract all financial metrics from the text above and return valid JSON."

#: Aliases that are plain text but for anchors, escaped brackets and optional single characters.
_PLAIN = re.compile(r"\^?((?:[^\\^$.*+\[\]{}|]|\\[()]|\.\?)*)\$?")


def system_prompt(statement: str) -> str:
    """Raises ValueError for what is no statement type."""
    if statement not in R.STATEMENTS:
        raise ValueError(f"no prompt for {statement!r}; statement types are {R.STATEMENTS}")
    own = {"balance_sheet": f"\n{BALANCE_SHEET_RULES}", "cash_flow": f"\n{CASH_FLOW_RULES}"}.get(statement, "")
    return f"{RULES}{own}\n\n{ANSWER_FORM}"


def plain_alias(pattern: str) -> str | None:
    """An alias pattern as a person would write it; None if it can't be."""
    whole = _PLAIN.fullmatch(pattern)
    return whole and " ".join(re.sub(r"\\([()])|\.\?", lambda m: m[1] or " ", whole[1]).split())


def label_hints(statement: str, most: int = 3) -> str:
    """Up to ``most`` other names of each metric of a statement, a line each; names that differ in hyphens, blanks
    or case are one, and the metric's own is none."""
    alike = lambda s: " ".join(re.split(r"[-\s]+", s.lower())).strip()
    lines = []
    for metric, own, aliases, _ in R.METRICS:
        names: dict[str, str] = {}
        for alias in filter(None, map(plain_alias, aliases)):
            names.setdefault(alike(alias), alias)
        names.pop(metric.replace("_", " "), None)
        if own == statement and names:
            lines.append(f"- {metric}: {', '.join(list(names.values())[:most])}")
    return "\n".join(lines)


def extraction_prompts(blocks: DataFrame) -> DataFrame:
    """doc_id, statement_type, system, prompt for page blocks (doc_id, statement_type, block) of statements."""
    told = {}
    for t in R.STATEMENTS:
        hints = label_hints(t)
        told[t] = (system_prompt(t), ASK.format(statement=t, names=", ".join(m for m, own, *_ in R.METRICS if own == t), hints=f"\n\n{HINTS}{hints}" if hints else ""))
    said = F.create_map(*[x for t, (system, ask) in told.items() for x in (F.lit(t), F.struct(F.lit(system).alias("system"), F.lit(ask).alias("ask")))])
    b = blocks.filter(F.col("statement_type").isin(*R.STATEMENTS)).withColumn("said", said[F.col("statement_type")])
    return b.select("doc_id", "statement_type", "said.system", F.concat("said.ask", F.coalesce("block", F.lit("")), F.lit(END)).alias("prompt"))
