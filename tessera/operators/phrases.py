"""The phrases and codes of the guards and the router, whole and in their order.

They are a contract (a text that holds one of them is treated so), hence given as text.
"""

# Signs of an attempt to take over the assistant.
INJECTION = (
    "ignore all previous", "ignore the", "disregard", "system prompt", "developer mode",
    "system override", "act as an unfiltered", "act as a", "roleplay as", "no restrictions",
    "hidden instructions", "raw configuration", "base64", "confidential leak", "jailbreak",
    "pretend the retrieved", "forget the filing context", "new instructions from the developer",
    "the text above this line is fake", "end the citation-integrity check",
)
# Requests for advice.
ADVICE = (
    "should i buy", "should i sell", "should i invest", "should i short", "should i take out a loan",
    "should i put my", "good time to invest", "guarantee me", "will beat earnings", "go up next quarter",
    "go bankrupt", "price target", "maximum profit", "personally invest", "stock going to crash",
    "bet my house", "confident prediction", "better investment than",
)
# Comparison of companies, change between years.
COMPARISON = ("which company", "compare", "higher", "lower", "greater than", "less than", "versus", " vs ")
CHANGE = (
    "change from", "changed from", "difference between", "how much did", "year-over-year",
    "year over year", "increase from", "decrease from", "grew from", "grow from",
)
# Words of the domain.
DOMAIN = (
    "10-k", "10-q", "8-k", "20-f", "s-1", "def 14a", "annual report", "quarterly report",
    "sec filing", "filing", "filings", "prospectus", "proxy statement", "edgar",
    "revenue", "earnings", "net income", "net loss", "profit", "assets", "liabilities",
    "stockholders equity", "shareholders equity", "cash flow", "balance sheet",
    "income statement", "eps", "earnings per share", "gross margin", "gross profit",
    "operating income", "operating expense", "expenses", "dividend", "shares outstanding",
    "market cap", "stock price", "cost of revenue", "tax expense",
    "company", "corporation", "fiscal year", "quarter", "ceo", "cfo", "board of directors",
    "shareholders", "stockholders", "subsidiary", "merger", "acquisition", "10k", "10q",
    "risk factor", "risk factors", "litigation", "competition", "regulatory", "compliance",
    "financial", "finance", "investment", "investor", "stock", "shares",
)
# What discusses attacks instead of being one, and how it does.
DISCUSSION = (
    "security training", "cybersecurity", "prompt injection", "quoted example", "training example", "audit committee",
    "policy", "risk disclosure", "discussed", "warned", "avoid", "prohibit",
)
DISCUSSING = ("example", "training", "warned", "avoid", "prohibit", "described", "discussed")
# Patterns of personal data, years, forms, items and accession numbers.
PII = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "card": r"\b\d{4}[- ]\d{4}[- ]\d{4}[- ]\d{4}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone": r"\b(?:\+?1[-.\s])?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b",
}
YEAR = r"\b((?:19|20)\d{2})\b"
FORM = r"(?i)\b(10-K/?A?|10-Q/?A?|8-K/?A?|20-F|S-1|DEF 14A)\b"
ITEM = r"(?i)\bitem\s+(\d{1,2}[abc]?)\b"
ACCESSION = r"\b(\d{10}-\d{2}-\d{6})\b"
CITATION = r"\[([^\[\]]+::chunk\d+)\]"
# Reasons of the guards, in order.
INPUT_REASONS = ("invalid_type", "empty_input", "input_too_long", "disallowed_control_character", "prompt_injection_detected", "advice_request_detected", "pii_detected", "out_of_scope")
OUTPUT_REASONS = ("malformed_citation", "unknown_citation", "unsupported_advice")
# Marks around a piece of evidence, invisible characters, fields that say where a text comes from.
EVIDENCE_BEGIN, EVIDENCE_END = "<<<BEGIN_RETRIEVED_EVIDENCE", "<<<END_RETRIEVED_EVIDENCE>>>"
ZERO_WIDTH = "​‌‍﻿⁠᠎"
PROVENANCE = ("chunk_id", "document_id", "text", "source")
# Fixed values: (concept, its label, quarters of its period, unit).
CONCEPTS = (
    ("Assets", "Total assets", 0, "USD"),
    ("Liabilities", "Total liabilities", 0, "USD"),
    ("StockholdersEquity", "Total stockholders' equity", 0, "USD"),
    ("CashAndCashEquivalentsAtCarryingValue", "Cash and cash equivalents", 0, "USD"),
    ("Revenues", "Total revenues", 4, "USD"),
    ("ResearchAndDevelopmentExpense", "Research and development expense", 4, "USD"),
    ("NetIncomeLoss", "Net income (loss)", 4, "USD"),
    ("OperatingIncomeLoss", "Operating income (loss)", 4, "USD"),
    ("CostOfRevenue", "Cost of revenue", 4, "USD"),
    ("GrossProfit", "Gross profit", 4, "USD"),
    ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenue from contracts with customers (ASC 606)", 4, "USD"),
    ("OperatingExpenses", "Total operating expenses", 4, "USD"),
    ("EarningsPerShareBasic", "Earnings per share, basic", 4, "USD"),
    ("EarningsPerShareDiluted", "Earnings per share, diluted", 4, "USD"),
    ("IncomeTaxExpenseBenefit", "Income tax expense (benefit)", 4, "USD"),
)
# The form and the fiscal years that are supported.
SUPPORTED_FORM, FIRST_YEAR, LAST_YEAR = "10-K", 2016, 2020
