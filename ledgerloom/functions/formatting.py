"""Display text of figures and dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom.functions.strings import bind

DASH = "—"


def to_fixed(value: Column, digits: int) -> Column:
    """Fixed-point text of a double, rounded on its exact binary value, halves away from zero.

    The whole part is taken off first. What is left is below one, so scaling it by
    2**62 is exact and the comparison with the half is made on whole numbers. From
    2**63 up a double has no fraction and its shortest decimal text is used.
    """
    size = F.abs(value)
    whole = F.floor(size)
    units = ((size - whole) * F.lit(2.0**62)).cast("bigint").cast("decimal(20,0)")
    power = 10**digits
    doubled = units * F.lit(power).cast("decimal(4,0)") + F.lit(2**61).cast("decimal(20,0)")
    # Whole-number division; an ordinary one would round the quotient.
    part = F.call_function("div", doubled, F.lit(2**62).cast("decimal(20,0)"))

    def text(rounded: Column) -> Column:
        front = (whole + F.call_function("div", rounded, F.lit(power))).cast("string")
        if not digits:
            return front
        return F.concat(front, F.lit("."), F.lpad((rounded % power).cast("string"), digits, "0"))

    exact = F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), bind(part, text))
    return F.when(size < 2.0**63, exact).when(value.isNotNull(), F.format_string(f"%.{digits}f", value))


def number_text(value: Column) -> Column:
    """A double the way a browser prints it: no exponent below 1e21, no trailing zeros."""
    printed = value.cast("string")
    whole = value.try_cast("decimal(38,0)").cast("string")
    plain = F.regexp_replace(printed.try_cast("decimal(38,20)").cast("string"), r"\.?0+\z", "")
    short = F.replace(printed, F.lit(".0E"), F.lit("E"))
    size = F.abs(value)
    return (
        F.when(value == 0, "0")
        .when(size >= 1e21, F.replace(short, F.lit("E"), F.lit("e+")))
        .when(value == F.rint(value), whole)
        .when(size < 1e-6, F.replace(short, F.lit("E"), F.lit("e")))
        .otherwise(plain)
    )


def grouped(value: Column) -> Column:
    """Digits in groups of three with at most three decimals."""

    def text(fixed: Column) -> Column:
        part = F.rtrim(F.substring_index(fixed, ".", -1), F.lit("0"))
        digits = F.format_number(F.substring_index(fixed, ".", 1).cast("bigint"), 0)
        return F.when(part == "", digits).otherwise(F.concat(digits, F.lit("."), part))

    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, bind(to_fixed(F.abs(value), 3), text))


def _money(value: Column, large: int, millions: int) -> Column:
    """``large`` decimals for trillions and billions, ``millions`` for millions."""
    size = F.abs(value)
    unit = F.when(size >= 1e12, F.lit(1e12)).otherwise(F.lit(1e9))
    letter = F.when(size >= 1e12, F.lit("T")).otherwise(F.lit("B"))
    return (
        F.when(size >= 1e9, F.concat(F.lit("$"), to_fixed(value / unit, large), letter))
        .when(size >= 1e6, F.concat(F.lit("$"), to_fixed(value / F.lit(1e6), millions), F.lit("M")))
        .when(value.isNotNull(), F.concat(F.lit("$"), grouped(value)))
    )


def currency(value: Column) -> Column:
    return F.coalesce(_money(value, 2, 1), F.lit("N/A"))


def currency_compact(value: Column) -> Column:
    """Shorter form for axes; null stays null."""
    return _money(value, 1, 0)


def money_cell(value: Column) -> Column:
    """Table cell: a gap is a dash."""
    return F.when(value.isNull(), DASH).otherwise(currency(value))


def per_share(value: Column) -> Column:
    text = F.concat(F.when(value < 0, F.lit("-$")).otherwise(F.lit("$")), to_fixed(F.abs(value), 2))
    return F.coalesce(text, F.lit(DASH))


def percent(value: Column) -> Column:
    return F.coalesce(F.concat(to_fixed(value, 1), F.lit("%")), F.lit("N/A"))


def date_text(value: Column) -> Column:
    """'May 2, 2026' for an ISO date, a dash for nothing, other text as it is."""
    day = value.try_cast("date")
    return (
        F.when(value.isNull() | (value == ""), DASH)
        .when(day.isNotNull(), F.date_format(day, "MMM d, yyyy"))
        .otherwise(value)
    )


def change_badge(change: Column) -> Column:
    """Arrow and absolute change; null when there is no change to show."""
    arrow = F.when(change >= 0, F.lit("▲ ")).otherwise(F.lit("▼ "))
    return F.concat(arrow, to_fixed(F.abs(change), 1), F.lit("%"))


# --- CSV ------------------------------------------------------------------------

def csv_field(text: Column) -> Column:
    """Null is empty; quotes only around values that need them."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.isNull(), "").when(text.rlike('[",\r\n]'), quoted).otherwise(text)


def csv_line(fields: list[Column]) -> Column:
    return F.concat_ws(",", *[csv_field(field) for field in fields])
