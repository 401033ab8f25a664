"""Whitespace, dates and identifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from ledgerloom import settings as S

# Every character Python's str.strip() removes.
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
SPACE_CLASS = r"[\s\x1c-\x1f\x85\p{Z}]"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), lambda bound: use(bound)), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def one_line(text: Column) -> Column:
    """Whitespace runs become one space, ends are trimmed."""
    return strip(F.regexp_replace(text, SPACE_CLASS + "+", " "))


def tidy_lines(text: Column) -> Column:
    """Every line stripped, blank lines dropped."""
    lines = F.transform(F.split(text, LINE_BREAK), strip)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


# --- dates -----------------------------------------------------------------

def iso_day(text: Column) -> Column:
    """Date of a y-m-d string with exactly three numeric parts, else null."""
    return F.when(F.translate(text, "0123456789", "") == "--", text.try_cast("date"))


def duration_days(start: Column, end: Column) -> Column:
    """Days from start to end; null when either is not a real calendar date."""
    return F.datediff(iso_day(end), iso_day(start))


def end_year(end: Column) -> Column:
    return F.substring(end, 1, 4).try_cast("int")


# --- identifiers -------------------------------------------------------------

def pad_cik(cik: Column, width: int = 10) -> Column:
    """Zero-filled on the left; a longer value is kept whole."""
    return F.when(F.length(cik) < width, F.lpad(cik, width, "0")).otherwise(cik)


def dashless(accession: Column) -> Column:
    return F.replace(accession, F.lit("-"), F.lit(""))


def index_url(cik: Column, accession: Column) -> Column:
    """Public index page of a filing: unpadded company number, dashless accession."""
    unpadded = F.regexp_replace(cik, r"\A0+(?=\d)", "")
    return F.concat(
        F.lit("https://www.sec.gov/Archives/edgar/data/"), unpadded, F.lit("/"), dashless(accession), F.lit("/")
    )


def normal_ticker(ticker: Column) -> Column:
    return F.upper(strip(ticker))


def is_annual_form(form: Column) -> Column:
    return form.startswith("10-K")


def request_errors(
    ticker: Column, cik: Column, accession: Column, company_name: Column, form: Column, document: Column
) -> Column:
    """Names of the fields that are not valid, empty for a good request."""

    def fails(name: str, ok: Column) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))

    checks = F.array(
        fails("ticker", normal_ticker(ticker).rlike(S.TICKER_PATTERN)),
        fails("cik", strip(cik).rlike(S.CIK_PATTERN)),
        fails("accession_number", strip(accession).rlike(S.ACCESSION_PATTERN)),
        fails("company_name", F.length(company_name).between(1, 200)),
        fails("form_type", F.upper(strip(form)).isin(*S.ALLOWED_FORMS)),
        fails(
            "primary_document",
            strip(document).rlike(S.DOCUMENT_PATTERN) & ~F.contains(document, F.lit("..")),
        ),
    )
    return F.array_compact(checks)


def document_keys(path: Column) -> Column:
    """(cik, accession_number, document) from the last three parts of a file path."""
    pattern = r"([^/]+)/([^/]+)/([^/]+)\z"
    return F.struct(
        F.regexp_extract(path, pattern, 1).alias("cik"),
        dashless(F.regexp_extract(path, pattern, 2)).alias("accession_number"),
        F.regexp_extract(path, pattern, 3).alias("document"),
    )
