"""Fact resolution: restated, multi-concept facts to one clean series per company.

Facts are rows of (cik, concept, unit, start, end, val, filed, ord); ``ord`` is
the position in the source document and decides between facts filed on the same
day. Winners are picked by aggregation, so a company with a third of all facts
costs each task one candidate per period.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom import settings as S
from ledgerloom.functions.formatting import date_text
from ledgerloom.functions.scoring import change_pct
from ledgerloom.functions.strings import duration_days, end_year, iso_day

Candidate = tuple[str, str, str, str, int]


def _lasts(middle: Column, half: Column) -> Column:
    """Duration of middle ± half days, written so that the dates are parsed once.

    An empty or malformed date has no duration and does not pass.
    """
    return F.abs(duration_days(F.col("start"), F.col("end")) - middle) <= half


def _is_instant() -> Column:
    return F.col("start").isNull() & end_year(F.col("end")).isNotNull()


_DAYS = {"annual": S.ANNUAL_DAYS, "quarterly": S.QUARTER_DAYS}


def _middle_and_half(kind: str) -> tuple[float, float]:
    low, high = _DAYS.get(kind, (0, 0))
    return (low + high) / 2, (high - low) / 2


def _qualifies(kind: str) -> Column:
    fits = _is_instant() if kind == "instant" else _lasts(*map(F.lit, _middle_and_half(kind)))
    return F.col("val").isNotNull() & fits


def _period(kind: str) -> Column:
    return F.col("end") if kind == "quarterly" else end_year(F.col("end"))


def _latest_filed(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The value filed last per key; the earliest entry wins a tie.

    ``first_seen`` is the position of the period's first entry, which is the
    order a reader of the document meets the periods in.
    """
    filed = F.coalesce(F.col("filed"), F.lit(""))
    order = F.struct(filed, -F.col("ord"), F.col("val"))
    return facts.groupBy(*keys).agg(
        F.max_by(F.col("val").cast("double"), order).alias("val"), F.min("ord").alias("first_seen")
    )


def period_values(facts: DataFrame, kind: str, unit: str | None = "USD") -> DataFrame:
    """(cik, concept, unit, period, val, first_seen) of one kind of fact."""
    rows = facts if unit is None else facts.filter(F.col("unit") == unit)
    rows = rows.filter(_qualifies(kind)).withColumn("period", _period(kind))
    return _latest_filed(rows, ["cik", "concept", "unit", "period"])


def annual_values(facts: DataFrame, unit: str | None = "USD") -> DataFrame:
    return period_values(facts, "annual", unit)


def instant_values(facts: DataFrame, unit: str | None = "USD") -> DataFrame:
    return period_values(facts, "instant", unit)


def quarterly_values(facts: DataFrame) -> DataFrame:
    return period_values(facts, "quarterly", "USD")


def candidate_table(facts: DataFrame, candidates: Sequence[Candidate]) -> DataFrame:
    """The candidate list as an inline table: a few dozen rows whatever the data."""
    rows = ", ".join(
        "({!r}, {!r}, {!r}, {!r}, {}, {}D, {}D)".format(*candidate, *_middle_and_half(candidate[3])) for candidate in candidates
    )
    return facts.sparkSession.sql(
        f"SELECT * FROM VALUES {rows} AS t(metric, concept, unit, kind, pref, middle, half)"
    )


def candidate_values(facts: DataFrame, candidates: Sequence[Candidate]) -> DataFrame:
    """Values of every candidate concept, all metrics and kinds in one aggregation."""
    kinds = {kind for _, _, _, kind, _ in candidates}
    tagged = facts.join(F.broadcast(candidate_table(facts, candidates)), ["concept", "unit"])
    fits = _lasts(F.col("middle"), F.col("half"))
    if "instant" in kinds:
        fits = F.when(F.col("kind") == "instant", _is_instant()).otherwise(fits)
    period = end_year(F.col("end")).cast("string")
    if "quarterly" in kinds:
        period = F.when(F.col("kind") == "quarterly", F.col("end")).otherwise(period)
    rows = tagged.filter(F.col("val").isNotNull() & fits).withColumn("period", period)
    return _latest_filed(rows, ["cik", "metric", "concept", "pref", "period"])


def select_series(values: DataFrame) -> DataFrame:
    """One concept per (cik, metric): latest period, then most periods, then preference.

    Candidates are never merged. ``values`` is already one row per period, so a
    company is a few hundred rows and one exchange by company serves every window.
    """
    per_concept = Window.partitionBy("cik", "metric", "concept")
    per_metric = Window.partitionBy("cik", "metric")
    reach = F.struct(F.max("period").over(per_concept), F.count("period").over(per_concept), -F.col("pref"))
    ranked = values.repartition("cik").withColumn("__reach", reach)
    best = ranked.withColumn("__best", F.max("__reach").over(per_metric))
    return best.filter(F.col("__reach") == F.col("__best")).drop("__reach", "__best")


def resolve_series(facts: DataFrame, candidates: Sequence[Candidate]) -> DataFrame:
    """(cik, metric, concept, pref, period, val, first_seen) of the chosen concepts."""
    return select_series(candidate_values(facts, candidates))


def period_frame(series: DataFrame, metrics: Sequence[str], last: int | None = None) -> DataFrame:
    """One row per company and period with a column per metric, all of them or the last ``last`` ones.

    Only periods with revenue or net income make a row; other metrics attach.
    """
    if last is not None and last < 1:
        raise ValueError("at least one period must be kept")
    columns = [F.max(F.when(F.col("metric") == m, F.col("val"))).alias(m) for m in metrics]
    framed = series.groupBy("cik", "period").agg(*columns)
    framed = framed.filter(F.col("revenue").isNotNull() | F.col("net_income").isNotNull())
    if last is None:
        return framed
    newest = Window.partitionBy("cik").orderBy(F.desc("period"))
    return framed.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= last).drop("__n")


def annual_frame(
    facts: DataFrame,
    candidates: Sequence[Candidate] = tuple(S.ANNUAL_CANDIDATES),
    max_years: int | None = None,
) -> DataFrame:
    """Annual financials of every company; order by fiscal_year to read them."""
    framed = period_frame(resolve_series(facts, candidates), S.ANNUAL_METRICS, max_years)
    year = F.col("period").cast("int").alias("fiscal_year")
    return framed.select("cik", year, *S.ANNUAL_METRICS)


def quarterly_frame(
    facts: DataFrame,
    candidates: Sequence[Candidate] = tuple(S.QUARTERLY_CANDIDATES),
    max_quarters: int | None = None,
) -> DataFrame:
    framed = period_frame(resolve_series(facts, candidates), S.FRAME_METRICS, max_quarters)
    return framed.withColumnRenamed("period", "period_end").select("cik", "period_end", *S.FRAME_METRICS)


def series_covering(values: DataFrame, years: DataFrame) -> DataFrame:
    """Whole series of the first preferred concept that has the named year.

    ``values`` as from ``candidate_values``; ``years`` holds (cik, fiscal_year).
    Unlike ``select_series`` the newest concept does not win.
    """
    wanted = years.select("cik", "fiscal_year").distinct()
    # A series is one entry per period, so it fits in an array.
    points = F.collect_list(F.struct("period", "val", "first_seen")).alias("points")
    series = values.groupBy("cik", "metric", "concept", "pref").agg(points)
    covers = F.exists("points", lambda p: p["period"].try_cast("int") == F.col("fiscal_year"))
    chosen = (
        wanted.join(series, "cik")
        .filter(covers)
        .groupBy("cik", "fiscal_year", "metric")
        .agg(F.min_by(F.struct("concept", "pref", "points"), "pref").alias("s"))
    )
    return chosen.select("cik", "fiscal_year", "metric", "s.concept", "s.pref", F.inline("s.points"))


def pick_fiscal_year(frame: DataFrame, filings: DataFrame) -> DataFrame:
    """(accession_number, fiscal_year): the newest framed year not after the filing year."""
    years = frame.filter(F.col("revenue").isNotNull() | F.col("net_income").isNotNull())
    covered = years.groupBy("cik").agg(F.array_sort(F.collect_set("fiscal_year")).alias("__years"))
    filed = F.year(iso_day(F.col("filing_date").cast("string")))
    reported = F.array_max(F.filter("__years", lambda year: year <= filed))
    return filings.join(covered, "cik").select("accession_number", reported.alias("fiscal_year")).dropna()


def ground_truth(facts: DataFrame, keys: DataFrame, candidates: Sequence[Candidate]) -> tuple[DataFrame, DataFrame]:
    """(truth, rejects) for (cik, fiscal_year) keys.

    The prior figure is that of exactly the year before in the same series.
    Keys that no concept covers go to ``rejects``: they are mistakes in the keys.
    """
    wanted = keys.select("cik", "fiscal_year").distinct()
    series = series_covering(candidate_values(facts, candidates), wanted)
    year = F.col("period").cast("int")

    def figure(metric: str, offset: int) -> Column:
        at = (F.col("metric") == metric) & (year == F.col("fiscal_year") - offset)
        return F.max(F.when(at, F.col("val")))

    def whole(metric: str) -> Column:
        # At most one entry per calendar year.
        point = F.struct(F.col("first_seen"), year.alias("period"), F.col("val"))
        points = F.array_sort(F.collect_list(F.when(F.col("metric") == metric, point)))
        return F.transform(points, lambda p: F.struct(p["period"].alias("period"), p["val"].alias("val")))

    truth = series.groupBy("cik", "fiscal_year").agg(
        figure("revenue", 0).alias("revenue"),
        figure("revenue", 1).alias("revenue_prior"),
        figure("net_income", 0).alias("net_income"),
        figure("net_income", 1).alias("net_income_prior"),
        whole("revenue").alias("revenue_series"),
        whole("net_income").alias("net_income_series"),
    )
    rejects = wanted.join(truth, ["cik", "fiscal_year"], "left_anti")
    return truth, rejects


def with_changes(truth: DataFrame) -> DataFrame:
    """Year-over-year changes of both metrics."""
    return truth.withColumn(
        "revenue_yoy_change_pct", change_pct(F.col("revenue"), F.col("revenue_prior"))
    ).withColumn("net_income_yoy_change_pct", change_pct(F.col("net_income"), F.col("net_income_prior")))


def annual_points(frame: DataFrame) -> DataFrame:
    """Chart points of an annual frame."""
    rows = frame.filter(F.col("revenue").isNotNull() | F.col("net_income").isNotNull())
    label = F.concat(F.lit("FY"), F.col("fiscal_year").cast("string"))
    return rows.select("cik", label.alias("label"), F.col("fiscal_year").cast("string").alias("sort_key"),
                       "revenue", "net_income")


def quarterly_points(frame: DataFrame) -> DataFrame:
    rows = frame.filter(F.col("revenue").isNotNull() | F.col("net_income").isNotNull())
    return rows.select("cik", date_text(F.col("period_end")).alias("label"),
                       F.col("period_end").alias("sort_key"), "revenue", "net_income")


def history_points(analyses: DataFrame) -> DataFrame:
    """Points from stored analyses, for companies without facts."""
    rows = analyses.filter(F.col("filing_date").isNotNull() & F.col("revenue_current").isNotNull())
    day = F.col("filing_date").cast("string")
    return rows.select("cik", date_text(day).alias("label"), day.alias("sort_key"),
                       F.col("revenue_current").alias("revenue"), F.col("net_income_current").alias("net_income"))


def trend_source(annual: DataFrame, quarterly: DataFrame, history: DataFrame, least: int = 2) -> DataFrame:
    """Which points a company's trend is drawn from: facts, else history, else none."""

    def tally(points: DataFrame, name: str) -> DataFrame:
        return points.groupBy("cik").agg(F.count(F.lit(1)).alias(name))

    counted = tally(annual, "annual_points").join(tally(quarterly, "quarterly_points"), "cik", "full_outer")
    counted = counted.join(tally(history, "history_points"), "cik", "full_outer").fillna(0)
    facts = (F.col("annual_points") >= least) | (F.col("quarterly_points") >= least)
    source = F.when(facts, "facts").when(F.col("history_points") >= least, "history")
    return counted.withColumn("source", F.coalesce(source, F.lit("none")))


def has_extra_metrics(frame: DataFrame) -> DataFrame:
    """Per company: any year with a figure beyond revenue and net income."""
    extra = [m for m in S.ANNUAL_METRICS if m not in S.FRAME_METRICS]
    present = F.coalesce(*[F.col(m) for m in extra]).isNotNull()
    return frame.groupBy("cik").agg(F.bool_or(present).alias("has_extra_metrics"))
