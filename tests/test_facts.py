from pyspark.sql import functions as F
import pytest

from ledgerloom import settings as S
from ledgerloom.functions.strings import duration_days
from ledgerloom.operators import facts as ops

SCHEMA = "cik string, concept string, unit string, start string, end string, val double, filed string, ord bigint"


def make(spark, rows):
    return spark.createDataFrame(
        [("1", concept, unit, start, end, val, filed, i) for i, (concept, unit, start, end, val, filed) in enumerate(rows)], SCHEMA
    )


def year(concept, y, val, filed="", unit="USD"):
    return (concept, unit, f"{y}-01-01", f"{y}-12-31", val, filed)


def values(frame):
    return {r.period: r.val for r in frame.collect()}


@pytest.mark.parametrize("start, end, days", [
    ("2020-01-01", "2020-12-31", 365), ("2020-02-30", "2020-12-31", None), ("2020", "2021-01-01", None),
    ("2020-1-5", "2020-1-6", 1), ("", "2020-01-01", None), (None, "2020-01-01", None), ("2020-01-01-1", "2020-01-02", None),
])
def test_duration(one, start, end, days):
    assert one(duration_days(F.lit(start).cast("string"), F.lit(end).cast("string")), x=1) == days


def test_annual_keeps_only_year_long_entries_under_the_end_year(spark):
    rows = [
        ("R", "USD", "2019-09-29", "2020-09-26", 7.0, "2020-10-30"), ("R", "USD", "2020-06-28", "2020-09-26", 2.0, "2020-10-30"),
        ("R", "USD", "2020-01-01", "2020-12-06", 1.0, "a"), ("R", "USD", "2018-01-01", "2019-02-06", 9.0, "b"),
        ("R", "USD", "2017-01-01", "2018-02-05", 8.0, "b"),
    ]
    # 363, 90, 340, 401 and 400 days; the two of 2020 collide and the later filing wins.
    assert values(ops.annual_values(make(spark, rows))) == {2020: 1.0, 2018: 8.0}


def test_restatement_latest_filed_wins_and_the_first_entry_wins_a_tie(spark):
    rows = [year("R", 2020, 1.0, "2021-02-01"), year("R", 2020, 2.0, "2022-02-01"), year("R", 2020, 3.0, "2022-02-01")]
    assert values(ops.annual_values(make(spark, rows))) == {2020: 2.0}
    missing = [year("R", 2020, 5.0, None), year("R", 2020, 6.0, "2021-01-01"), year("R", 2021, 7.0, None), year("R", 2021, 8.0, None)]
    assert values(ops.annual_values(make(spark, missing))) == {2020: 6.0, 2021: 7.0}


def test_malformed_entries_are_skipped(spark):
    rows = [
        ("R", "USD", None, "2020-12-31", 1.0, "a"), ("R", "USD", "", "2020-12-31", 1.0, "a"), ("R", "USD", "2020-01-01", "2020-12-31", None, "a"),
        ("R", "USD", "2020-01-01", "2020-13-31", 1.0, "a"), ("R", "USD", "2020-01-01", None, 1.0, "a"),
    ]
    assert ops.annual_values(make(spark, rows)).count() == 0


def test_instants_need_a_null_start(spark):
    rows = [
        ("C", "USD", None, "2020-09-26", 1.0, "2020-11-01"), ("C", "USD", None, "2020-09-26", 2.0, "2021-11-01"),
        ("C", "USD", "", "2020-09-26", 3.0, "2022-11-01"), ("C", "USD", None, "20x0-01-01", 4.0, "2022"), ("C", "USD", None, "2019", 5.0, "x"),
        ("C", "USD", "2020-01-01", "2020-09-26", 6.0, "2023"),
    ]
    assert values(ops.instant_values(make(spark, rows))) == {2020: 2.0, 2019: 5.0}


def test_quarters_are_keyed_by_end_date(spark):
    rows = [
        ("R", "USD", "2020-01-01", "2020-03-31", 1.0, "a"), ("R", "USD", "2020-01-01", "2020-06-30", 2.0, "a"),
        ("R", "USD", "2020-04-01", "2020-06-30", 3.0, "a"), ("R", "USD", "2020-04-01", "2020-06-30", 4.0, "b"),
    ]
    assert values(ops.quarterly_values(make(spark, rows))) == {"2020-03-31": 1.0, "2020-06-30": 4.0}


CANDIDATES = [("revenue", "A", "USD", "annual", 0), ("revenue", "B", "USD", "annual", 1), ("net_income", "N", "USD", "annual", 0)]


@pytest.mark.parametrize("a, b, winner", [
    ([2018, 2019], [2019, 2020], "B"), ([2019, 2020], [2020], "A"), ([2020], [2019, 2020], "B"), ([2019, 2020], [2019, 2020], "A"), ([], [2020], "B"),
])
def test_freshest_then_broadest_then_preferred_concept(spark, a, b, winner):
    rows = [year("A", y, 1.0) for y in a] + [year("B", y, 2.0) for y in b]
    series = ops.resolve_series(make(spark, rows), CANDIDATES).collect()
    assert {r.concept for r in series} == {winner}
    # Never spliced: only the winner's own periods.
    assert sorted(int(r.period) for r in series) == (a if winner == "A" else b)


def test_annual_frame_rows_come_from_the_income_statement(spark):
    rows = [year("Revenues", y, float(y)) for y in range(2005, 2016)] + [year("NetIncomeLoss", 2016, 3.0)]
    rows += [("Assets", "USD", None, f"{y}-12-31", 1.0, "x") for y in (2010, 2015, 2020)]
    rows += [year("EarningsPerShareDiluted", 2015, 2.5, "", "USD/shares"), year("EarningsPerShareDiluted", 2014, 9.0, "", "USD")]
    frame = {r.fiscal_year: r for r in ops.annual_frame(make(spark, rows), max_years=8).collect()}
    assert sorted(frame) == list(range(2009, 2017))
    assert frame[2010].total_assets == 1.0 and frame[2011].total_assets is None
    assert frame[2015].eps_diluted == 2.5 and frame[2014].eps_diluted is None
    assert frame[2016].revenue is None and frame[2016].net_income == 3.0


def test_zero_periods_is_refused(spark):
    with pytest.raises(ValueError):
        ops.annual_frame(make(spark, [year("Revenues", 2020, 1.0)]), max_years=0)


def test_covering_series_prefers_order_over_freshness(spark):
    rows = [year("A", 2015, 1.0), year("A", 2014, 2.0), year("B", 2015, 3.0), year("B", 2020, 4.0), year("N", 2015, 5.0)]
    facts = make(spark, rows)
    keys = spark.createDataFrame([("1", 2015), ("1", 2020), ("1", 1999)], "cik string, fiscal_year int")
    truth, rejects = ops.ground_truth(facts, keys, CANDIDATES)
    found = {r.fiscal_year: r for r in truth.collect()}
    assert (found[2015].revenue, found[2015].revenue_prior, found[2015].net_income) == (1.0, 2.0, 5.0)
    # 2020 is only in B, whose year before is missing; 2015 is not its prior year.
    assert (found[2020].revenue, found[2020].revenue_prior, found[2020].net_income) == (4.0, None, None)
    assert [p.period for p in found[2015].revenue_series] == [2015, 2014]
    assert [r.fiscal_year for r in rejects.collect()] == [1999]


def test_fiscal_year_is_the_newest_not_after_the_filing(spark):
    frame = spark.createDataFrame([("1", 2019, 1.0, None), ("1", 2020, None, 1.0), ("1", 2021, None, None)],
                                  "cik string, fiscal_year int, revenue double, net_income double")
    filings = spark.createDataFrame([("a", "1", "2021-02-01"), ("b", "1", "2019-12-31"), ("c", "1", "2001-01-01")],
                                    "accession_number string, cik string, filing_date string")
    assert {r[0]: r[1] for r in ops.pick_fiscal_year(frame, filings).collect()} == {"a": 2020, "b": 2019}


def test_candidate_lists_cover_every_metric():
    assert [m for m in S.ANNUAL_METRICS if m not in {c[0] for c in S.ANNUAL_CANDIDATES}] == []
