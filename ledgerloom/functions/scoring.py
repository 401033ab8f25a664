"""Verdicts on extracted figures."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom import settings as S

_SCORE = "struct<verdict:string,detail:string>"


def _score(verdict: str, detail: Column | str = "") -> Column:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return F.struct(F.lit(verdict).alias("verdict"), detail.alias("detail"))


def within_tolerance(value: Column, truth: Column, tolerance: float = S.TOLERANCE) -> Column:
    """Relative comparison, absolute where the truth is zero."""
    relative = F.try_divide(F.abs(value - truth), F.abs(truth)) <= tolerance
    return F.when(truth == 0, F.abs(value) <= S.ZERO_TOLERANCE).otherwise(relative)


def classify_miss(value: Column, truth: Column, series: Column) -> Column:
    """Why a figure is wrong: sign, then scale, then period, else other.

    ``series`` is an array of (period, val) in order of first appearance.
    """
    flipped = (truth != 0) & within_tolerance(F.abs(value), F.abs(truth)) & ((value < 0) != (truth < 0))
    label = F.when(flipped, "sign")
    ratio = F.try_divide(F.abs(value), F.abs(truth))
    for factor, text in S.SCALE_FACTORS:
        label = label.when((truth != 0) & within_tolerance(ratio, F.lit(factor)), f"scale (×{text})")
        label = label.when((truth != 0) & within_tolerance(ratio, F.lit(1 / factor)), f"scale (÷{text})")
    others = F.filter(series, lambda p: (p["val"] != truth) & within_tolerance(value, p["val"]))
    period = F.try_element_at(others, F.lit(1))["period"]
    return label.when(
        period.isNotNull(), F.concat(F.lit("period (matches FY"), period.cast("string"), F.lit(")"))
    ).otherwise("other")


def score_value(value: Column, truth: Column, series: Column) -> Column:
    return (
        F.when(truth.isNull(), _score("no_ground_truth"))
        .when(value.isNull(), _score("wrong", "missing"))
        .when(within_tolerance(value, truth), _score("correct"))
        .otherwise(_score("wrong", classify_miss(value, truth, series)))
        .cast(_SCORE)
    )


def score_direction(change_pct: Column, current: Column, prior: Column) -> Column:
    """Only the direction of the change is compared, never its size."""
    delta = current - prior
    return (
        F.when(delta.isNull() | (delta == 0), _score("no_ground_truth"))
        .when(change_pct.isNull(), _score("wrong", "missing"))
        .when(change_pct == 0, _score("wrong", "sign"))
        .when((change_pct > 0) == (delta > 0), _score("correct"))
        .otherwise(_score("wrong", "sign"))
        .cast(_SCORE)
    )


def change_pct(current: Column, prior: Column) -> Column:
    """Year-over-year change in percent, one decimal; null without a prior figure."""
    return F.round(F.try_divide(current - prior, F.abs(prior)) * 100, 1)
