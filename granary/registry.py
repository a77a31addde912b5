"""Fixed values of the statement domain: metrics, phrases, weights and thresholds."""

from __future__ import annotations

# Metric, statement, alias patterns, exclude patterns. The order is the order of matching.
METRICS: list[tuple[str, str, list[str], list[str]]] = [
    ("revenue", "income_statement",
     [r"^revenue from operations$", r"^revenue$", r"^turnover$", r"^sales$", r"^net sales$", r"^income from operations$", r"^net revenue$", r"^total revenue$",
      r"^value of sales(?: & services)?(?: \(revenue\))?$"],
     ["segment", "ebitda", "margin", "deliveries", "higher by", "previous year", "operations stood at", "turnover at", "%"]),
    ("gross_profit", "income_statement", [r"^gross profit$", r"^gross profit/\(loss\)$"], ["margin", "%", "higher by", "previous year"]),
    ("operating_profit", "income_statement",
     [r"^operating profit$", r"^profit from operations$", r"^profit before finance costs and depreciation$", r"^ebit$", r"^earnings before interest and tax$",
      r"^profit before interest, depreciation and tax$", r"^profit before interest and tax$", r"^operating income$"],
     ["margin", "%", "higher by", "previous year", "segment"]),
    ("net_profit", "income_statement",
     [r"^profit for the year$", r"^profit for the period$", r"^profit after tax$", r"^net profit$", r"^net income$", r"^profit /\(loss\) for the year$",
      r"^profit \(loss\) for the year$", r"^loss for the year$", r"^profit after tax for the year$", r"^net profit attributable to:?$"],
     ["margin", "net profit margin", "%", "higher by", "previous year"]),
    ("interest_expense", "income_statement",
     [r"^finance costs$", r"^interest expense$", r"^finance charges$", r"^interest and finance charges$", r"^interest cost$", r"^borrowing costs$", r"^finance cost$"],
     ["capitalised", "capitalized", "%", "higher by"]),
    ("total_assets", "balance_sheet", [r"^total assets$"], ["and liabilities", "liabilities and equity", "net"]),
    ("current_assets", "balance_sheet", [r"^total current assets$", r"^current assets$"], ["other current assets", "charge on the company", "pari-passu"]),
    ("cash_and_equivalents", "balance_sheet",
     [r"^cash and cash equivalents$", r"^cash and bank balances$", r"^cash and cash equivalent$", r"^cash & cash equivalents$"],
     ["net increase", "decrease", "movement", "beginning of the year", "end of the year", "closing cash", "opening cash"]),
    ("total_liabilities", "balance_sheet", [r"^total liabilities$"], ["and equity", "liabilities and equity"]),
    ("current_liabilities", "balance_sheet", [r"^total current liabilities$", r"^current liabilities$"], ["other current liabilities"]),
    ("long_term_debt", "balance_sheet", [r"^non-current borrowings$", r"^long.?term borrowings$", r"^long.?term debt$", r"^borrowings$"],
     ["proceeds from", "repayment", "foreign currency borrowings", "borrowings include", "current maturities"]),
    ("short_term_debt", "balance_sheet",
     [r"^short.?term borrowings$", r"^current borrowings$", r"^current maturities of long.?term debt$", r"^current maturities of borrowings$", r"^working capital loans$"],
     ["proceeds from", "repayment"]),
    ("total_equity", "balance_sheet",
     [r"^total equity$", r"^equity attributable to owners", r"^total equity attributable to owners", r"^total shareholders.? equity$", r"^shareholders.? equity$"],
     ["liabilities and equity"]),
    ("operating_cash_flow", "cash_flow",
     [r"^net cash from operating activities$", r"^net cash generated from operating activities$", r"^net cash flow from operating activities$",
      r"^cash flows from operating activities$", r"^net cash from/\(used in\) operating activities$",
      r"^net cash generated from(?: /\(used in\))? operating activities$", r"^net cash provided by operating activities$", r"^cash from operating activities$"], []),
    ("investing_cash_flow", "cash_flow",
     [r"^net cash from investing activities$", r"^net cash from/\(used in\) investing activities$", r"^net cash generated from /\(used in\) investing activities$",
      r"^net cash used in investing activities$", r"^cash flows from investing activities$", r"^net cash inflow\s*/\s*\(used in\) investing activities$"], []),
    ("financing_cash_flow", "cash_flow",
     [r"^net cash from financing activities$", r"^net cash from/\(used in\) financing activities$", r"^net cash generated from(?: /\(used in\))? financing activities$",
      r"^net cash used in financing activities$", r"^cash flows from financing activities$"], []),
    ("capex", "cash_flow",
     [r"^purchase of property, plant and equipment$", r"^purchase of property, plant & equipment$", r"^acquisition of property, plant and equipment$", r"^capital expenditure$",
      r"^purchase of fixed assets$", r"^additions to property, plant and equipment$", r"^payment for purchase of property, plant and equipment$"],
     ["proceeds from", "sale of", "disposal"]),
]
METRIC_NAMES = [m[0] for m in METRICS]
STATEMENT_OF = {m[0]: m[1] for m in METRICS}

# The metrics that completeness is measured by, and statement types.
CORE = ["revenue", "net_profit", "total_assets", "current_assets", "current_liabilities", "total_equity", "total_liabilities", "operating_cash_flow"]
STATEMENTS = ["balance_sheet", "income_statement", "cash_flow"]

# Reporting units by what a page says, first match wins.
UNIT_HINTS = [("crore", ["in crore", "(₹ in crore)", "(rs. in crore)", "(₹ crore)", " crore)"]), ("lakh", ["in lakh", "(₹ in lakh)", "(rs. in lakh)"]), ("million", ["in million", "usd million", "$ million"])]

# Phrases of prose lines; hints that a header row goes on.
PROSE = ["higher by", "as compared", "compared to", "previous year", "during the year", "the company", "the group", "consists of", "management discussion", "integrated report", "annual report", "sensitivity", "assumption", "quoted", "unquoted"]
HEADER_HINTS = ["crore", "lakh", "million", "₹", "rs.", "note", "%"]

# Statement titles, narrative kinds, checklist words; order is the order of matching.
TITLES = [("balance_sheet", ["balance sheet", "statement of financial position"]),
          ("income_statement", ["profit and loss", "statement of profit", "income statement", "revenue from operations", "statement of operations"]),
          ("cash_flow", ["cash flow statement", "cash flows from operating", "statement of cash flow"])]
NARRATIVE = [("notes", ["notes to", "notes forming part", "significant accounting policies"]), ("mda", ["management discussion", "md&a", "management's discussion and analysis"])]
CHECKLIST = {"balance_sheet": ["assets", "liabilities", "equity"], "income_statement": ["revenue", "expenses", "profit", "tax"], "cash_flow": ["operating activities", "investing activities", "financing activities"]}
SECTIONS = [("mda", ["management discussion", "md&a", "management's discussion"]), ("risk_factors", ["risk factor", "risks and concerns", "key risks"]), ("notes", ["notes to", "notes forming part", "significant accounting"]), ("liquidity", ["liquidity", "capital resources"])]

# Ranks that resolution orders by.
SECTION_RANK = {"consolidated": 2, "unknown": 1, "standalone": 0}
CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1, "derived": 0}
TABLE_SOURCE = "docling_table"
LINE_SOURCE = "line_parse_fallback"

# Page scoring weights and caps.
WEIGHTS = {"heading": 3.0, "numbers": 4.0, "cells": 2.0, "totals": 3.0, "checklist": 2.0, "currency": 1.0}
LEAST_NUMBERS, NUMBERS_CAP, TOTALS_CAP = 5, 20, 8

# Ratio, numerator, denominator, inputs of the scope guard. A ratio is numerator over denominator
# but for free_cash_flow; total_debt stands for the sum of the two debts.
RATIOS = [
    ("current_ratio", "current_assets", "current_liabilities", ["current_assets", "current_liabilities"]),
    ("cash_ratio", "cash_and_equivalents", "current_liabilities", ["cash_and_equivalents", "current_liabilities"]),
    ("debt_to_equity", "total_debt", "total_equity", ["long_term_debt", "short_term_debt", "total_equity"]),
    ("debt_ratio", "total_liabilities", "total_assets", ["total_liabilities", "total_assets"]),
    ("interest_coverage", "operating_profit", "interest_expense", ["operating_profit", "interest_expense"]),
    ("profit_margin", "net_profit", "revenue", ["net_profit", "revenue"]),
    ("operating_margin", "operating_profit", "revenue", ["operating_profit", "revenue"]),
    ("gross_margin", "gross_profit", "revenue", ["gross_profit", "revenue"]),
    ("asset_turnover", "revenue", "total_assets", ["revenue", "total_assets"]),
    ("ocf_to_revenue", "operating_cash_flow", "revenue", ["operating_cash_flow", "revenue"]),
    ("free_cash_flow", "operating_cash_flow", "capex", ["operating_cash_flow", "capex"]),
]
GROWTH = [("yoy_revenue_growth", "revenue"), ("yoy_profit_growth", "net_profit"), ("yoy_asset_growth", "total_assets")]
OCF_THRESHOLD = 100.0

# Risk, driver, upper ends of High and Medium (for debt, lower ends), and what the driver's state comes from.
RISKS = [("liquidity_risk", "current_ratio", 1.0, 1.5), ("debt_risk", "debt_to_equity", 2.0, 1.0), ("profitability_risk", "profit_margin", 0.0, 0.05), ("cashflow_risk", "operating_cash_flow", 0.0, OCF_THRESHOLD)]
RISK_CODE = {"High": 3, "Medium": 2, "Low": 1, "Unknown": 0}

# Thresholds of risks in words, and the ratio that each is read from (none for cash flow).
THRESHOLDS = {
    "liquidity_risk": "< 1.0 = High, 1.0-1.5 = Medium, >= 1.5 = Low",
    "debt_risk": "< 1.0 = Low, 1.0-2.0 = Medium, > 2.0 = High",
    "profitability_risk": "< 0 = High, 0-5% = Medium, >= 5% = Low",
    "cashflow_risk": "< 0 = High, 0-100 Cr = Medium, >= 100 Cr = Low",
}
RISK_OF_RATIO = {"current_ratio": "liquidity_risk", "debt_to_equity": "debt_risk", "profit_margin": "profitability_risk"}

# Upload gates, and what a page of a financial document says.
UPLOAD_MOST_BYTES, GATE_PAGES = 50 * 1024 * 1024, 30
FINANCIAL_WORDS = ["balance sheet", "profit and loss", "cash flow", "annual report", "10-k", "10-q"]

# What reading a document runs into, by its status; a document that isn't there has none.
GUARD_CODES = {"processing": "DOC_PROCESSING", "failed": "DOC_FAILED"}
NOT_THERE = "DOC_NOT_FOUND"
