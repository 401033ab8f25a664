"""Stored analyses and filings over time, and the company directory.

Analyses are rows of (id, accession_number, cik, ticker, …, filing_date date,
…, created_at timestamp); filings of (cik, accession_number, form_type,
filing_date, primary_document, primary_doc_description, ord).
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom import settings as S
from ledgerloom.functions.similarity import content_words, jaccard, substantive_risks
from ledgerloom.functions.strings import strip
from ledgerloom.operators.facts import Candidate, annual_frame, ground_truth, pick_fiscal_year
from ledgerloom.operators.setjoin import earliest_similar
from ledgerloom.operators.skew import best_row, salts_of, top_k
from ledgerloom.session import kept

NEWEST = ("created_at", "id")


# --- filters and lookups -----------------------------------------------------

def by_forms(filings: DataFrame, forms: str | None = None) -> DataFrame:
    """Filings of the named forms, a comma-separated list in any case; annual and quarterly by default."""
    names = list(S.DEFAULT_FORMS) if forms is None else [f.strip().upper() for f in forms.split(",")]
    return filings.filter(F.upper("form_type").isin(*names))


def by_ticker(analyses: DataFrame, ticker: str) -> DataFrame:
    return analyses.filter(F.col("ticker") == ticker.upper())


def lookup(analyses: DataFrame, wanted: DataFrame, key: str = "accession_number") -> DataFrame:
    """Rows whose key is in ``wanted``; for one key filter on equality instead."""
    return analyses.join(wanted.select(key).distinct(), key, "left_semi")


def total_rows(analyses: DataFrame, ticker: str | None = None) -> DataFrame:
    rows = by_ticker(analyses, ticker) if ticker else analyses
    return rows.agg(F.count(F.lit(1)).alias("total"))


def page_index(analyses: DataFrame) -> DataFrame:
    """(hour, n, before, total): analyses created in every hour, those created after it, and all of them.

    An ordinal index for pages from the newest on. It has a row for each hour of the
    calendar at most, whatever the number of analyses; those without a time are the last.
    """
    hours = analyses.groupBy(F.date_trunc("hour", F.col("created_at")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    newer = Window.orderBy(F.desc_nulls_last("hour"))
    before = F.coalesce(F.sum("n").over(newer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = newer.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return hours.select("hour", "n", before.alias("before"), F.sum("n").over(whole).alias("total"))


def page(
    analyses: DataFrame, limit: int = S.PAGE_ROWS, offset: int = 0, ticker: str | None = None, index: DataFrame | None = None
) -> DataFrame:
    """Newest analyses first, ``limit`` of them from ``offset`` on, each with the exact total.

    The index (``page_index`` of the same rows, kept or made here) tells which hours the
    page lies in. Only their analyses are ordered, so a deep page gathers no more rows
    than a first one.
    """
    rows = by_ticker(analyses, ticker) if ticker else analyses
    hours = page_index(rows) if index is None else index
    asked = hours.filter((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset))
    hour = F.date_trunc("hour", F.col("created_at"))
    met = rows.join(asked.select(F.col("hour").alias("__hour"), "before", "total"), hour.eqNullSafe(F.col("__hour")))
    inside = Window.partitionBy("__hour").orderBy(F.desc("created_at"), F.desc("id"))
    place = F.col("before") + F.row_number().over(inside)
    found = met.withColumn("__place", place).filter((F.col("__place") > offset) & (F.col("__place") <= offset + limit))
    return found.orderBy("__place").select(*analyses.columns, "total")


# --- newest and first per company ------------------------------------------------

def latest_analysis(analyses: DataFrame) -> DataFrame:
    """The analysis created last, per ticker."""
    return best_row(analyses, ["ticker"], [F.col(c) for c in NEWEST])


def first_filings(filings: DataFrame, n: int, forms: str | None = None) -> DataFrame:
    """The first ``n`` filings per company in index order, after the form filter."""
    kept = by_forms(filings, forms)
    return top_k(kept, ["cik"], [F.col("ord")], n, spread=["ord"]).drop("rank")


# --- prior filing, staleness, comparison -----------------------------------------

def prior_analysis(analyses: DataFrame, columns: Sequence[str] = ("id",), limit: int | None = None) -> DataFrame:
    """Every analysis with the one filed most recently, strictly before it, for its ticker.

    Adds ``prior_<column>``. Of several filed that day the one created last
    counts. ``limit`` restricts the candidates to a ticker's newest created
    rows. Candidates shrink to one row per ticker and filing date before the
    ordered pass, so it sees a ticker's calendar, not its rows.
    """
    dated = analyses.filter(F.col("filing_date").isNotNull())
    pool = analyses
    if limit is not None:
        pool = top_k(analyses, ["ticker"], [F.desc(c) for c in NEWEST], limit, spread=["id"])
    found = pool.filter(F.col("filing_date").isNotNull()).select("ticker", "filing_date", *NEWEST, *[
        F.col(c).alias(f"prior_{c}") for c in columns
    ])
    per_day = best_row(found, ["ticker", "filing_date"], [F.col(c) for c in NEWEST]).select(
        "ticker", "filing_date", F.struct(*[f"prior_{c}" for c in columns]).alias("__row")
    )
    days = dated.select("ticker", "filing_date").distinct()
    marks = days.join(per_day, ["ticker", "filing_date"], "left")
    before = Window.partitionBy("ticker").orderBy("filing_date").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.select("ticker", "filing_date", F.last("__row", ignorenulls=True).over(before).alias("__prior"))
    joined = analyses.join(marks, ["ticker", "filing_date"], "left")
    return joined.select("*", "__prior.*").drop("__prior")


def stale_companies(watched: DataFrame, filings: DataFrame, analyses: DataFrame, by_filing_date: bool = False) -> DataFrame:
    """Watched companies with a flag for filings that no analysis has caught up to.

    Compares with the analysis created last, or filed last with ``by_filing_date``.
    """
    newest_filing = first_filings(filings, 1).select("cik", F.col("filing_date").alias("latest_filing"))
    order = ("filing_date", *NEWEST) if by_filing_date else NEWEST
    newest = analyses.groupBy("ticker").agg(
        F.max_by("filing_date", F.struct(*order)).alias("analyzed_filing")
    )
    joined = watched.join(newest_filing, "cik", "left").join(newest, "ticker", "left")
    newer = F.col("analyzed_filing").isNull() | (F.col("latest_filing") > F.col("analyzed_filing"))
    return joined.withColumn("has_new_filing", F.col("latest_filing").isNotNull() & newer)


def compare_companies(pairs: DataFrame, analyses: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Latest analyses of both tickers of each (left_ticker, right_ticker) pair, side by side."""
    latest = latest_analysis(analyses)

    def side(name: str) -> DataFrame:
        return latest.select(F.col("ticker").alias(f"{name}_ticker"), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    return pairs.join(side("left"), "left_ticker", "left").join(side("right"), "right_ticker", "left")


# --- risk drift ------------------------------------------------------------------

def risk_drift(pairs: DataFrame, threshold: float = S.DRIFT_THRESHOLD) -> DataFrame:
    """Adds ``is_new`` and ``dropped`` for rows with risk_factors and prior_risk_factors.

    Null unless both lists hold real risks. Lists are short (five by contract),
    so they are compared inside the row; every sentence is cut into words once.
    """
    words = pairs.withColumn("__now", F.transform("risk_factors", lambda r: content_words(r))).withColumn(
        "__then", F.transform("prior_risk_factors", lambda r: content_words(r))
    )

    def unmatched(mine: str, others: str) -> Column:
        return F.transform(mine, lambda a: ~F.exists(others, lambda b: jaccard(a, b) >= threshold))

    comparable = F.coalesce(
        substantive_risks(F.col("risk_factors")) & substantive_risks(F.col("prior_risk_factors")), F.lit(False)
    )
    gone = F.arrays_zip(F.col("prior_risk_factors").alias("risk"), unmatched("__then", "__now").alias("gone"))
    dropped = F.transform(F.filter(gone, lambda r: r["gone"]), lambda r: r["risk"])
    return (
        words.withColumn("is_new", F.when(comparable, unmatched("__now", "__then")))
        .withColumn("dropped", F.when(comparable, dropped))
        .drop("__now", "__then")
    )


def corpus_risk_drift(analyses: DataFrame, threshold: float = S.DRIFT_THRESHOLD) -> DataFrame:
    """(id, position, risk, first_id, is_new): whether any filing of any company had a similar risk before.

    Filings follow each other by (filing_date, id), undated ones last. ``first_id`` is
    the first filing with a risk whose words reach the similarity, a filing's own ones
    included; a risk is new where that is its own filing. A risk without words is
    always new. Equal word sets are looked up once, by ``setjoin``.
    """
    ratio = Fraction(str(threshold))
    order = F.struct(F.col("filing_date").isNull().alias("undated"), "filing_date", "id")
    risks = analyses.select("id", order.alias("at"), F.posexplode("risk_factors").alias("position", "risk"))
    risks = risks.withColumn("words", F.array_sort(content_words(F.col("risk"))))
    # Words are letters and digits, so their text tells sets apart.
    # They are cut out once, the sets and the answers both read them.
    risks = kept(risks.withColumn("key", F.unhex(F.md5(F.array_join("words", " ")))), "risks")
    worded = risks.filter(F.size("words") > 0)
    sets = worded.groupBy("key").agg(F.any_value("words").alias("words"), F.min("at").alias("first"))
    earliest = earliest_similar(sets, ratio.numerator, ratio.denominator)
    found = risks.join(earliest, "key", "left").withColumn("first_id", F.coalesce("earliest.id", "id"))
    return found.select("id", "position", "risk", "first_id", (F.col("first_id") == F.col("id")).alias("is_new"))


# --- directory search ---------------------------------------------------------------

GRAM = 3
# Pieces of queries that are sent to every task; a megabyte or so of them.
FEW_PIECES = 20_000


def _grams(text: Column) -> Column:
    """Distinct substrings of 1 to ``GRAM`` characters."""
    sizes = [
        F.when(
            F.length(text) >= n,
            F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))),
        ).otherwise(F.array().cast("array<string>"))
        for n in range(1, GRAM + 1)
    ]
    return F.array_distinct(F.concat(*sizes))


def _query_grams(query: Column) -> Column:
    """The longest indexed substrings of a query."""
    n = F.least(F.length(query), F.lit(GRAM))
    starts = F.sequence(F.lit(1), F.length(query) - n + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.substring(query, i, n)))


def search_directory(queries: DataFrame, directory: DataFrame, limit: int = S.SEARCH_ROWS, few: int = FEW_PIECES) -> DataFrame:
    """Ranked companies for each query: exact ticker, ticker prefix, then substring.

    ``directory``: (cik, ticker, name, ord); ``queries``: (query). Literal
    matching, any case. Candidates come from an equi-join on the rarest
    three-character piece of the query, so queries never meet the whole directory.
    The pieces of queries are sent to the companies while they are ``few``; more are
    shuffled with them.
    """
    asked = queries.select("query", strip(F.upper("query")).alias("__q")).filter(F.col("__q") != "").distinct()
    asked = kept(asked, "searches")
    # A directory is a small file or two, its pieces are work for many tasks.
    spread = directory.repartition(salts_of(directory), "ord")
    known = spread.withColumn("__t", F.upper("ticker")).withColumn("__n", F.upper("name"))
    grams = F.explode(F.array_union(_grams(F.col("__t")), _grams(F.col("__n")))).alias("__gram")
    pieces = asked.select("query", "__q", F.explode(_query_grams(F.col("__q"))).alias("__gram"))

    # The pieces of a directory are many times its size, which the planner cannot tell: they
    # are never the side that is sent to every task.
    few = pieces.count() <= few
    asked_grams = pieces.select("__gram").distinct()
    index = known.select("ord", grams).join(F.broadcast(asked_grams) if few else asked_grams.hint("merge"), "__gram", "left_semi")
    sizes = index.groupBy("__gram").agg(F.count(F.lit(1)).alias("__size"))
    rarest = (
        pieces.join(sizes, "__gram", "left")
        .groupBy("query", "__q")
        .agg(F.min(F.struct(F.coalesce("__size", F.lit(0)).alias("size"), F.col("__gram").alias("gram"))).alias("__best"))
        .select("query", "__q", F.col("__best.gram").alias("__gram"))
    )
    if few:
        found = known.select("*", grams).join(F.broadcast(rarest), "__gram")
    else:
        # Companies are spread by salt, so a piece that a third of them share is
        # matched by many tasks.
        salts = salts_of(known)
        salted = known.select("*", grams).withColumn("__salt", F.pmod(F.xxhash64("ord"), F.lit(salts)))
        copies = rarest.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
        found = salted.join(copies.hint("merge"), ["__gram", "__salt"])

    tier = (
        F.when(F.col("__t") == F.col("__q"), 0)
        .when(F.startswith("__t", "__q"), 1)
        .when(F.contains("__t", "__q") | F.contains("__n", "__q"), 2)
    )
    ranked = found.withColumn("tier", tier).filter(F.col("tier").isNotNull())
    ranked = ranked.select("query", "cik", "ticker", "name", "ord", "tier")
    return top_k(ranked, ["query"], [F.col("tier"), F.col("ord")], limit, spread=["ord"])


def resolve_tickers(wanted: DataFrame, directory: DataFrame) -> DataFrame:
    """Exact ticker matches, any case; the first listed company wins. Unknown tickers drop out."""
    first = best_row(directory.withColumn("__t", F.upper("ticker")), ["__t"], [-F.col("ord")])
    asked = wanted.select(F.col("ticker").alias("asked"), F.upper("ticker").alias("__t"))
    return asked.join(first, "__t").drop("__t")


# --- profile -----------------------------------------------------------------------

def company_profile(
    wanted: DataFrame,
    directory: DataFrame,
    filings: DataFrame,
    annual: DataFrame,
    quarterly: DataFrame,
    analyses: DataFrame,
    n_filings: int,
    n_analyses: int,
) -> DataFrame:
    """One row per known ticker: first filings, financials and newest analyses as arrays.

    ``annual`` and ``quarterly`` are frames of a bounded number of periods.
    """
    companies = resolve_tickers(wanted, directory)

    def gathered(rows: DataFrame, key: str, columns: Sequence[str], name: str) -> DataFrame:
        items = F.array_sort(F.collect_list(F.struct(*columns)))
        return rows.groupBy(key).agg(items.alias(name))

    listed = gathered(first_filings(filings, n_filings), "cik", ["ord", "accession_number", "form_type", "filing_date"], "filings")
    years = gathered(annual, "cik", ["fiscal_year", *S.ANNUAL_METRICS], "years")
    quarters = gathered(quarterly, "cik", ["period_end", *S.FRAME_METRICS], "quarters")
    newest = top_k(analyses, ["ticker"], [F.desc(c) for c in NEWEST], n_analyses, spread=["id"])
    history = gathered(newest, "ticker", ["rank", "id", "accession_number", "filing_date"], "history")
    profile = companies
    for part in (listed, years, quarters):
        profile = profile.join(part, "cik", "left")
    return profile.join(history, "ticker", "left")


def build_golden(
    wanted: DataFrame,
    directory: DataFrame,
    filings: DataFrame,
    facts: DataFrame,
    candidates: Sequence[Candidate],
    form: str = "10-K",
) -> tuple[DataFrame, DataFrame]:
    """(golden entries, dropped tickers with a reason).

    Exact ticker, its first filing of the form, the fiscal year it reports and
    a note on truth that is missing for that year.
    """
    companies = resolve_tickers(wanted, directory)
    newest = first_filings(filings, 1, form).select(
        "cik", "accession_number", "form_type", "filing_date", "primary_document"
    )
    filed = companies.join(newest, "cik", "left")
    frame = annual_frame(facts, candidates)
    years = pick_fiscal_year(frame, filed.filter(F.col("accession_number").isNotNull()))
    dated = filed.join(years, "accession_number", "left")
    truth, _ = ground_truth(facts, dated.filter(F.col("fiscal_year").isNotNull()), candidates)
    figures = truth.select("cik", "fiscal_year", "revenue", "revenue_prior", "net_income_prior")
    entries = dated.join(figures, ["cik", "fiscal_year"])
    note = F.concat_ws(
        "; ",
        F.when(F.col("revenue").isNull(), "no XBRL revenue concept covers this year"),
        F.when(
            F.col("revenue_prior").isNull() | F.col("net_income_prior").isNull(), "prior year missing (YoY unscoreable)"
        ),
    )
    golden = entries.select(
        "ticker", "cik", F.col("name").alias("company_name"), "accession_number", "primary_document",
        "form_type", "fiscal_year", note.alias("note"),
    )
    known = dated.select("asked", F.when(F.col("accession_number").isNull(), "no filing of the form")
                         .when(F.col("fiscal_year").isNull(), "no annual data at or before the filing").alias("reason"))
    missing = wanted.select(F.col("ticker").alias("asked")).join(known, "asked", "left_anti")
    dropped = known.filter(F.col("reason").isNotNull()).unionByName(
        missing.withColumn("reason", F.lit("no exact ticker match"))
    )
    return golden, dropped
