from pyspark.sql import functions as F
import pytest

from ledgerloom.functions import scoring as sc
from ledgerloom.operators import evaluation as ev
from ledgerloom.operators.history import build_golden

def series():
    return F.array(*[F.struct(F.lit(p).alias("period"), F.lit(v).alias("val")) for p, v in [(2020, 100.0), (2019, 80.0), (2018, 80.0)]])


def number(value):
    return F.lit(value).cast("double")


@pytest.mark.parametrize("value, truth, ok", [
    (101.0, 100.0, True), (101.01, 100.0, False), (99.0, 100.0, True), (-100.0, 100.0, False),
    (1.0, 0.0, True), (1.01, 0.0, False), (-99.5, -100.0, True),
])
def test_tolerance(one, value, truth, ok):
    assert one(sc.within_tolerance(number(value), number(truth)), x=1) is ok


@pytest.mark.parametrize("value, truth, verdict, detail", [
    (100.4, 100.0, "correct", ""), (None, 100.0, "wrong", "missing"), (5.0, None, "no_ground_truth", ""),
    (-100.0, 100.0, "wrong", "sign"), (100_500.0, 100.0, "wrong", "scale (×1e+03)"), (0.0001, 100.0, "wrong", "scale (÷1e+06)"),
    (-100e9, 100.0, "wrong", "scale (×1e+09)"), (80.0, 100.0, "wrong", "period (matches FY2019)"), (55.0, 100.0, "wrong", "other"),
    (50.0, 0.0, "wrong", "other"), (80.0, 0.0, "wrong", "period (matches FY2019)"), (0.0, 100.0, "wrong", "other"),
])
def test_value_verdicts(one, value, truth, verdict, detail):
    assert tuple(one(sc.score_value(number(value), number(truth), series()), x=1)) == (verdict, detail)


@pytest.mark.parametrize("pct, now, before, verdict, detail", [
    (5.0, 2.0, 1.0, "correct", ""), (-5.0, 2.0, 1.0, "wrong", "sign"), (0.0, 2.0, 1.0, "wrong", "sign"), (None, 2.0, 1.0, "wrong", "missing"),
    (5.0, 1.0, 1.0, "no_ground_truth", ""), (5.0, None, 1.0, "no_ground_truth", ""), (5.0, 1.0, None, "no_ground_truth", ""),
    (-900.0, -2.0, -1.0, "correct", ""),
])
def test_direction_verdicts(one, pct, now, before, verdict, detail):
    assert tuple(one(sc.score_direction(number(pct), number(now), number(before)), x=1)) == (verdict, detail)


def test_change(one):
    assert one(sc.change_pct(number(110.0), number(-100.0)), x=1) == 210.0
    assert one(sc.change_pct(number(1.0), number(0.0)), x=1) is None
    assert one(sc.change_pct(number(1.0), number(None)), x=1) is None


def scores(spark, rows):
    return spark.createDataFrame(
        [(t, 2020, f"acc-{t}", i, f, v, d) for t, i, f, v, d in rows],
        "ticker string, fiscal_year int, accession_number string, position int, field string, verdict string, detail string")


def test_totals_and_accuracy(spark):
    frame = scores(spark, [("A", 0, "revenue", "correct", ""), ("A", 1, "net income", "wrong", "sign"), ("A", 2, "x", "no_ground_truth", ""),
                           ("B", 0, "revenue", "error", "boom"), ("B", 1, "net income", "no_ground_truth", "")])
    rows = {r.ticker: r for r in ev.verdict_totals(frame, ["ticker"]).collect()}
    assert (rows["A"].scored, rows["A"].accuracy) == (2, 0.5)
    assert (rows["B"].errors, rows["B"].scored, rows["B"].accuracy) == (1, 0, None)


def test_notes(spark):
    frame = scores(spark, [("A", 1, "net income", "wrong", "sign"), ("A", 0, "revenue", "no_ground_truth", ""), ("A", 2, "c", "correct", ""),
                           ("B", 0, "revenue", "error", "boom"), ("C", 0, "revenue", "correct", "")])
    notes = {r.ticker: r.notes for r in ev.record_notes(frame).collect()}
    assert notes == {"A": "revenue: no XBRL concept; net income: sign", "B": "run failed: boom", "C": ""}


def test_regressions_ignore_errors_and_new_tickers(spark):
    before = scores(spark, [("A", 0, "revenue", "correct", ""), ("A", 1, "net income", "wrong", "sign"), ("B", 0, "revenue", "correct", "")])
    now = scores(spark, [("A", 0, "revenue", "wrong", "other"), ("A", 1, "net income", "wrong", "sign"), ("B", 0, "revenue", "error", "x"),
                         ("C", 0, "revenue", "wrong", "sign")])
    assert [(r.ticker, r.field, r.detail) for r in ev.regressions(now, before).collect()] == [("A", "revenue", "other")]


@pytest.mark.parametrize("now, before, label", [
    (0.9, 0.8, "+10.0 pts"), (0.8, 0.9, "-10.0 pts"), (0.8004, 0.8, "no change"), (None, 0.8, "not comparable"), (0.8, None, "not comparable"),
])
def test_delta(spark, now, before, label):
    frame = [spark.createDataFrame([("r", x)], "run string, accuracy double") for x in (now, before)]
    assert ev.delta_to_baseline(*frame, ["run"]).first().change == label


def test_resume_only_under_the_same_settings(spark):
    prior = spark.createDataFrame(
        [("a", "m", "", 10, None, 0), ("a", "m", "", 10, None, 1), ("b", "m", "", 10, "boom", 2), ("c", "m", "", 10, "", 3)],
        "accession_number string, model string, fallback_model string, max_filing_chars int, error string, ord int")
    todo = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "accession_number string")

    def split(*settings):
        config = spark.createDataFrame([settings], "model string, fallback_model string, max_filing_chars int")
        keep, left = ev.split_reusable(todo, prior, config)
        return sorted((r.accession_number, r.ord) for r in keep.collect()), sorted(r[0] for r in left.collect())

    assert split("m", "", 10) == ([("a", 1), ("c", 3)], ["b", "d"])
    for other in (("n", "", 10), ("m", "f", 10), ("m", "", 11)):
        assert split(*other) == ([], ["a", "b", "c", "d"])


def test_golden_builder(spark):
    directory = spark.createDataFrame([("1", "ABC", "Abc Inc", 0), ("2", "ABCD", "Abcd", 1), ("3", "XYZ", "Xyz", 2)],
                                      "cik string, ticker string, name string, ord int")
    filings = spark.createDataFrame([("1", "a1", "10-K", "2021-02-01", "d.htm", 0), ("1", "a0", "10-K", "2020-02-01", "c.htm", 1), ("2", "b", "10-Q", "2021-01-01", "e.htm", 0)],
                                    "cik string, accession_number string, form_type string, filing_date string, primary_document string, ord int")
    facts = spark.createDataFrame(
        [("1", "Revenues", "USD", "2020-01-01", "2020-12-31", 5.0, "x", 0), ("1", "NetIncomeLoss", "USD", "2019-01-01", "2019-12-31", 1.0, "x", 1)],
        "cik string, concept string, unit string, start string, end string, val double, filed string, ord int")
    from ledgerloom import settings as S

    wanted = spark.createDataFrame([("abc",), ("abcd",), ("AB",)], "ticker string")
    golden, dropped = build_golden(wanted, directory, filings, facts, S.ANNUAL_CANDIDATES)
    row = golden.first()
    assert (row.ticker, row.accession_number, row.fiscal_year, row.note) == ("ABC", "a1", 2020, "prior year missing (YoY unscoreable)")
    assert {r.asked: r.reason for r in dropped.collect()} == {"abcd": "no filing of the form", "AB": "no exact ticker match"}
