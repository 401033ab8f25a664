from pyspark.sql import functions as F
import pytest

from ledgerloom.functions import formatting as fmt


def number(value):
    return F.lit(value).cast("double")


@pytest.mark.parametrize("value, digits, text", [
    (1.005, 2, "1.00"), (0.125, 2, "0.13"), (-0.125, 2, "-0.13"), (2.5, 0, "3"), (0.25, 1, "0.3"), (248.85, 1, "248.8"), (0.0, 1, "0.0"),
    (-0.001, 2, "-0.00"), (999.995, 2, "1000.00"), (1234.5678, 2, "1234.57"), (0.004999, 2, "0.00"), (3_000_000.25, 1, "3000000.3"), (None, 1, None),
    (4194304.5, 0, "4194305"), (-4194305.125, 2, "-4194305.13"), (2.0**40 + 0.375, 2, "1099511627776.38"), (2097153.005, 2, "2097153.00"),
    (8.345, 2, "8.35"), (1.45, 1, "1.4"), (0.05, 1, "0.1"), (1e-9, 2, "0.00"),
])
def test_fixed_point_rounds_the_exact_value(one, value, digits, text):
    assert one(fmt.to_fixed(number(value), digits), x=1) == text


@pytest.mark.parametrize("value, full, compact", [
    (2.34e12, "$2.34T", "$2.3T"), (-2.5e9, "$-2.50B", "$-2.5B"), (61_500_000.0, "$61.5M", "$62M"), (870_000.0, "$870,000", "$870,000"),
    (1234.5678, "$1,234.568", "$1,234.568"), (-12.5, "$-12.5", "$-12.5"), (0.0, "$0", "$0"), (None, "N/A", None), (999_999.9999, "$1,000,000", "$1,000,000"),
])
def test_currency(one, value, full, compact):
    assert one(fmt.currency(number(value)), x=1) == full
    assert one(fmt.currency_compact(number(value)), x=1) == compact


def test_small_figures(one):
    def show(function, value):
        return one(function(number(value)), x=1)

    assert [show(fmt.per_share, v) for v in (6.1, -0.5, None)] == ["$6.10", "-$0.50", "—"]
    assert [show(fmt.percent, v) for v in (5.56, -3.2, None)] == ["5.6%", "-3.2%", "N/A"]
    assert [show(fmt.change_badge, v) for v in (5.56, 0.0, -3.2, None)] == ["▲ 5.6%", "▲ 0.0%", "▼ 3.2%", None]
    assert [show(fmt.money_cell, v) for v in (None, 1e6)] == ["—", "$1.0M"]


@pytest.mark.parametrize("value, text", [("2026-05-02", "May 2, 2026"), (None, "—"), ("", "—"), ("not-a-date", "not-a-date")])
def test_dates(one, value, text):
    assert one(fmt.date_text(F.lit(value).cast("string")), x=1) == text


@pytest.mark.parametrize("value, text", [
    (1e9, "1000000000"), (5.5, "5.5"), (-0.1, "-0.1"), (12345678.9, "12345678.9"), (1e20, "100000000000000000000"), (1e21, "1e+21"), (-2.5e25, "-2.5e+25"), (2e-8, "2e-8"), (1.5e-7, "1.5e-7"),
    (0.0, "0"), (123456789012345.6, "123456789012345.6"),
])
def test_number_text(one, value, text):
    assert one(fmt.number_text(number(value)), x=1) == text


@pytest.mark.parametrize("value, field", [("a", "a"), ("a,b", '"a,b"'), ('say "x"', '"say ""x"""'), ("a\nb", '"a\nb"'), ("a\rb", '"a\rb"'), (None, ""), ("", "")])
def test_csv_fields(one, value, field):
    assert one(fmt.csv_field(F.lit(value).cast("string")), x=1) == field
