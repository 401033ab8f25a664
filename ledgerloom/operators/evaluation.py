"""Scoring extracted figures against resolved facts.

Records are rows of (run columns…, ticker, cik, accession_number, fiscal_year,
revenue_current, revenue_yoy_change_pct, net_income_current,
net_income_yoy_change_pct, error).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom import settings as S
from ledgerloom.functions.scoring import score_direction, score_value
from ledgerloom.functions.strings import request_errors
from ledgerloom.operators.skew import best_row

RUN = ("run_date", "tag")
CONFIG = ("model", "fallback_model", "max_filing_chars")


def has_error() -> Column:
    return F.col("error").isNotNull() & (F.col("error") != "")


def attach_truth(records: DataFrame, truth: DataFrame) -> DataFrame:
    """Records with the truth of their filing year; errored records need none."""
    return records.join(truth, ["cik", "fiscal_year"], "left")


def score_records(joined: DataFrame) -> DataFrame:
    """Long form: one row per record and scored field, with verdict and detail."""
    failed = F.struct(F.lit("error").alias("verdict"), F.col("error").alias("detail"))

    def scored(field: str, position: int, score: Column) -> Column:
        result = F.when(has_error(), failed).otherwise(score)
        return F.struct(
            F.lit(position).alias("position"),
            F.lit(field).alias("field"),
            result["verdict"].alias("verdict"),
            result["detail"].alias("detail"),
        )

    c = F.col
    scores = [
        score_value(c("revenue_current"), c("revenue"), c("revenue_series")),
        score_value(c("net_income_current"), c("net_income"), c("net_income_series")),
        score_direction(c("revenue_yoy_change_pct"), c("revenue"), c("revenue_prior")),
        score_direction(c("net_income_yoy_change_pct"), c("net_income"), c("net_income_prior")),
    ]
    fields = F.array(*[scored(f, i, s) for i, (f, s) in enumerate(zip(S.SCORED_FIELDS, scores))])
    run = [c for c in (*RUN, *CONFIG) if c in joined.columns]
    return joined.select(*run, "ticker", "fiscal_year", "accession_number", F.inline(fields))


def verdict_totals(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per verdict; accuracy is null when nothing was scored."""

    def tally(verdict: str) -> Column:
        return F.count_if(F.col("verdict") == verdict)

    totals = scores.groupBy(*keys).agg(
        tally("correct").alias("correct"),
        tally("wrong").alias("wrong"),
        tally("no_ground_truth").alias("no_ground_truth"),
        tally("error").alias("errors"),
    )
    scored = F.col("correct") + F.col("wrong")
    return totals.withColumn("scored", scored).withColumn(
        "accuracy", F.try_divide(F.col("correct").cast("double"), scored)
    )


def run_history(scores: DataFrame) -> DataFrame:
    """One line per saved run under the current rules; show newest run_date first."""
    keys = [c for c in (*RUN, *CONFIG) if c in scores.columns]
    totals = verdict_totals(scores, keys)
    return totals.withColumn(
        "filings", ((F.col("scored") + F.col("no_ground_truth") + F.col("errors")) / len(S.SCORED_FIELDS)).cast("bigint")
    )


def delta_to_baseline(current: DataFrame, baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accuracy change in points and a label, for totals that share ``keys``."""
    base = baseline.select(*keys, F.col("accuracy").alias("baseline_accuracy"))
    points = (F.col("accuracy") - F.col("baseline_accuracy")) * 100
    label = (
        F.when(points.isNull(), "not comparable")
        .when(F.abs(points) < S.UNCHANGED_POINTS, "no change")
        .otherwise(F.concat(F.when(points >= 0, "+").otherwise("-"), F.format_string("%.1f", F.abs(points)), F.lit(" pts")))
    )
    return current.join(base, list(keys), "left").withColumn("delta_points", points).withColumn("change", label)


def regressions(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(ticker, field, detail) that were correct in the baseline and are wrong now.

    When the baseline scored a ticker more than once its last record counts.
    """
    order = F.struct("fiscal_year", "accession_number")
    before = baseline.groupBy("ticker", "field").agg(F.max_by("verdict", order).alias("before"))
    now = current.filter(F.col("verdict") == "wrong")
    return now.join(before.filter(F.col("before") == "correct"), ["ticker", "field"]).select(
        "ticker", "fiscal_year", "field", "detail"
    )


def record_notes(scores: DataFrame) -> DataFrame:
    """One text per record saying what is wrong or could not be scored."""
    missed = F.concat(F.col("field"), F.lit(": "), F.col("detail"))
    text = F.when((F.col("verdict") == "wrong") & (F.col("detail") != ""), missed).when(
        F.col("verdict") == "no_ground_truth", F.concat(F.col("field"), F.lit(": no XBRL concept"))
    )
    run = [c for c in RUN if c in scores.columns]
    # Four fields per record.
    parts = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("position", text.alias("text")))))
    error = F.max(F.when(F.col("verdict") == "error", F.col("detail")))
    grouped = scores.groupBy(*run, "ticker", "fiscal_year", "accession_number").agg(
        parts.alias("__parts"), error.alias("__error")
    )
    notes = F.array_join(F.transform("__parts", lambda p: p["text"]), "; ")
    note = F.coalesce(F.concat(F.lit("run failed: "), F.col("__error")), notes)
    return grouped.withColumn("notes", note).drop("__parts", "__error")


def reusable_records(prior: DataFrame, settings: DataFrame) -> DataFrame:
    """Successful records of an earlier run made under one of these settings.

    ``settings`` has a row of (model, fallback_model, max_filing_chars) for every setup that counts.
    """
    same = prior.join(settings, list(CONFIG), "left_semi")
    return same.filter(~has_error())


def split_reusable(todo: DataFrame, prior: DataFrame, settings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records to reuse, entries still to run) for golden entries ``todo``.

    ``ord`` is a record's position in its run; of a filing recorded twice the last counts.
    """
    keep = best_row(reusable_records(prior, settings), ["accession_number"], [F.col("ord")])
    keep = keep.join(todo.select("accession_number").distinct(), "accession_number", "left_semi")
    return keep, todo.join(keep, "accession_number", "left_anti")


def golden_problems(golden: DataFrame, least: int = 10) -> DataFrame:
    """Rows, distinct tickers and invalid rows of a golden set, and whether it is sound."""
    c = F.col
    errors = request_errors(
        c("ticker"), c("cik"), c("accession_number"), c("company_name"), c("form_type"), c("primary_document")
    )
    report = golden.agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_distinct("ticker").alias("tickers"),
        F.count_if(F.size(errors) > 0).alias("invalid"),
    )
    sound = (c("entries") >= least) & (c("entries") == c("tickers")) & (c("invalid") == 0)
    return report.withColumn("sound", sound)
