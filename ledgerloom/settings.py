"""Limits, word lists and patterns shared by the operators.

Everything here is a fixed value of the filings domain; the operators take
them as defaulted parameters.
"""

from __future__ import annotations

# --- Fixed values: financial concepts per metric -------------------------
# (metric, concept, unit, kind, preference); kind is annual, instant or quarterly.
REVENUE_CONCEPTS = [
    "RevenueFromContractWithCustomerExcludingAssessedTax",
    "Revenues",
    "SalesRevenueNet",
    "RevenueFromContractWithCustomerIncludingAssessedTax",
]
NET_INCOME_CONCEPTS = ["NetIncomeLoss"]
EPS_CONCEPTS = ["EarningsPerShareDiluted", "EarningsPerShareBasicAndDiluted"]
OPERATING_CASH_FLOW_CONCEPTS = [
    "NetCashProvidedByUsedInOperatingActivities",
    "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations",
]
CASH_CONCEPTS = [
    "CashAndCashEquivalentsAtCarryingValue",
    "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents",
]
TOTAL_ASSETS_CONCEPTS = ["Assets"]
STOCKHOLDERS_EQUITY_CONCEPTS = [
    "StockholdersEquity",
    "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
]


def _candidates(metric, concepts, unit, kind):
    return [(metric, concept, unit, kind, pref) for pref, concept in enumerate(concepts)]


ANNUAL_CANDIDATES = (
    _candidates("revenue", REVENUE_CONCEPTS, "USD", "annual")
    + _candidates("net_income", NET_INCOME_CONCEPTS, "USD", "annual")
    + _candidates("eps_diluted", EPS_CONCEPTS, "USD/shares", "annual")
    + _candidates("operating_cash_flow", OPERATING_CASH_FLOW_CONCEPTS, "USD", "annual")
    + _candidates("cash", CASH_CONCEPTS, "USD", "instant")
    + _candidates("total_assets", TOTAL_ASSETS_CONCEPTS, "USD", "instant")
    + _candidates("stockholders_equity", STOCKHOLDERS_EQUITY_CONCEPTS, "USD", "instant")
)
QUARTERLY_CANDIDATES = _candidates("revenue", REVENUE_CONCEPTS, "USD", "quarterly") + _candidates(
    "net_income", NET_INCOME_CONCEPTS, "USD", "quarterly"
)

ANNUAL_METRICS = [
    "revenue",
    "net_income",
    "eps_diluted",
    "operating_cash_flow",
    "cash",
    "total_assets",
    "stockholders_equity",
]
FRAME_METRICS = ["revenue", "net_income"]

# --- Fixed values: period lengths in days, both ends included ------------
ANNUAL_DAYS = (340, 400)
QUARTER_DAYS = (80, 100)
MAX_YEARS = 8
MAX_QUARTERS = 12

# --- Fixed values: filings ------------------------------------------------
DEFAULT_FORMS = ("10-K", "10-Q")
ALLOWED_FORMS = ("10-K", "10-Q", "10-K/A", "10-Q/A")
TICKER_PATTERN = r"\A[A-Z][A-Z0-9.\-]{0,9}\z"
CIK_PATTERN = r"\A\d{1,10}\z"
ACCESSION_PATTERN = r"\A\d{10}-?\d{2}-?\d{6}\z"
DOCUMENT_PATTERN = r"\A[A-Za-z0-9._\-/]{1,255}\z"
FILINGS_PER_COMPANY = 10
HISTORY_ROWS = 12
PAGE_ROWS = 20
SEARCH_ROWS = 10

# --- Fixed values: document preparation -----------------------------------
MAX_FILING_CHARS = 600_000
HEAD_CHARS = 20_000
CHUNK_CHARS = 2_000
CHUNK_OVERLAP = 200
CHARS_PER_TOKEN = 1.8
TOKEN_BUDGET = 27_000
RATE_WINDOW_SECONDS = 60
EMBEDDING_DIM = 768

_SEP = r"[\s.,:;—–-]*"
_APOSTROPHE = r"['’‘`]?"
RISK_START = rf"item{_SEP}1a{_SEP}risk\s+factors"
RISK_END = r"item\s*1b\b|item\s*2\b"
MDA_START = rf"item{_SEP}[27]{_SEP}management{_APOSTROPHE}s?\s+discussion"
MDA_END = r"item\s*[38]\b"
# In the order in which the truncation considers them.
SECTIONS = ((MDA_START, MDA_END), (RISK_START, RISK_END))

SCALE_WORDS = ("thousands", "millions", "billions")
SCALE_PARENTHETICAL = (
    r"\(\s*([^()\n]{0,200}?\bin (?:thousands|millions|billions)\b[^()\n]{0,200}?)\s*\)"
)
SCALE_SENTENCE = (
    r"\b((?:amounts|dollars|figures|numbers)\s+(?:are\s+)?"
    r"(?:expressed\s+|stated\s+|presented\s+)?in\s+(?:thousands|millions|billions))\b"
)
SCALE_CANDIDATES = 3

# --- Fixed values: retrieval ----------------------------------------------
RETRIEVED_CHUNKS = 6
EXCERPT_CHARS = 300
QUESTION_CHARS = (3, 300)

# --- Fixed values: risk drift ---------------------------------------------
STOP_WORDS = [
    "the", "and", "for", "that", "with", "from", "its", "are", "our", "has", "have", "may", "could", "would",
    "will", "can", "not", "any", "into", "which", "their", "there", "been", "being", "this", "these", "those",
    "company", "companys", "risk", "risks", "including", "such", "other", "significant", "material", "adverse",
    "adversely", "affect", "impact",
]
DRIFT_THRESHOLD = 0.25
NO_CHANGES = "no material changes"

# --- Fixed values: evaluation ---------------------------------------------
TOLERANCE = 0.01
ZERO_TOLERANCE = 1.0
SCALE_FACTORS = ((1e3, "1e+03"), (1e6, "1e+06"), (1e9, "1e+09"))
SCORED_FIELDS = ("revenue", "net income", "revenue YoY", "net income YoY")
UNCHANGED_POINTS = 0.05

# --- Fixed values: metering -----------------------------------------------
DAILY_CAP = 200
RECENT_ITEMS = 5
MAX_RETRY_SECONDS = 120.0
RETRY_DELAY_PATTERN = r"""retryDelay['"]?\s*[:=]\s*['"]?(\d+(?:\.\d+)?)s"""
DAILY_QUOTA_PATTERN = r"(?i)quota exceeded for metric:\s*\S*_requests\b"
FETCH_RETRY_CODES = (403, 429, 500, 502, 503, 504)
TRANSIENT_ERRORS = (
    "RemoteDisconnected",
    "ProtocolError",
    "ConnectionError",
    "ConnectError",
    "ConnectTimeout",
    "ReadTimeout",
    "ReadError",
    "TimeoutException",
    "ServerDisconnectedError",
)


def max_chunks(max_chars: int = MAX_FILING_CHARS, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> int:
    """Chunks needed to cover a text of ``max_chars``."""
    return -(-max_chars // max(size - overlap, 1))
