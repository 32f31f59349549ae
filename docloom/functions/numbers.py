"""Fiscal dates, calculations, quantities, units, number formats and axis steps as Column builders (SC-50 to SC-64, AG-28)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fiscal year ends on 31 March; scales and currencies as printed.
FISCAL_END = 3
SCALES = {"crore": 1e7, "cr": 1e7, "lakh": 1e5, "million": 1e6, "mn": 1e6, "billion": 1e9, "bn": 1e9, "thousand": 1e3, "k": 1e3}
CURRENCIES = {"₹": "INR", "rs": "INR", "inr": "INR", "$": "USD", "usd": "USD", "€": "EUR", "eur": "EUR", "£": "GBP", "gbp": "GBP"}
NULL_MARKS = ["", "-", "–", "—", "n.a.", "na", "n/a", "nil", "nm", "लागू नहीं"]


def fiscal_year(date: Column) -> Column:
    """SC-54: the year in which the fiscal year of a date ends."""
    return F.year(date) + (F.month(date) > FISCAL_END).cast("int")


def fiscal_quarter(date: Column) -> Column:
    """SC-54: 1 for April to June."""
    return (F.floor(((F.month(date) + 8) % 12) / 3) + 1).cast("int")


def fiscal_label(date: Column, part: str = "year") -> Column:
    """SC-54: FY99, 1QFY99 or H1FY99."""
    fy = F.format_string("FY%02d", fiscal_year(date) % 100)
    if part == "quarter":
        return F.concat(fiscal_quarter(date).cast("string"), F.lit("Q"), fy)
    if part == "half":
        return F.concat(F.when(fiscal_quarter(date) <= 2, "H1").otherwise("H2"), fy)
    return fy


def fiscal_end(date: Column) -> Column:
    """SC-52, SC-54: 31 March that ends the fiscal year of a date."""
    return F.make_date(fiscal_year(date), F.lit(3), F.lit(31))


def years_between(start: Column, end: Column) -> Column:
    """SC-55: months between period ends over twelve; null below twelve months."""
    months = (F.year(end) * 12 + F.month(end)) - (F.year(start) * 12 + F.month(start))
    return F.when(months >= 12, months / 12)


def growth(a: Column, b: Column) -> Column:
    """AG-28: percent from a to b, one decimal; the base must be positive."""
    return F.when(a > 0, F.round(100 * (b - a) / a, 1) + F.lit(0.0))


def cagr(a: Column, b: Column, years: Column) -> Column:
    """AG-28: yearly growth in percent; both ends positive, a year apart at least."""
    return F.when((a > 0) & (b > 0) & (years >= 1), F.round(100 * (F.pow(b / a, 1 / years) - 1), 1) + F.lit(0.0))


def difference(a: Column, b: Column, digits: int) -> Column:
    """AG-28: at the most decimals of the two."""
    return F.round(b - a, digits) + F.lit(0.0)


def ratio(a: Column, b: Column) -> Column:
    """AG-28: two decimals; null over zero."""
    return F.round(F.try_divide(a, b), 2)


def share(part: Column, whole: Column) -> Column:
    """AG-28: percent, one decimal; a positive whole and no negative part."""
    return F.when((whole > 0) & (part >= 0), F.round(100 * part / whole, 1))


def agrees(shown: Column, value: Column, digits: int) -> Column:
    """AG-29: within half a unit of the last decimal shown."""
    return F.abs(shown - value) <= 0.5 * 10.0**-digits + 1e-9


def nice_step(span: Column, ticks: int) -> Column:
    """SC-58: the step of 1, 2, 5 or 10 times a power of ten nearest to span / ticks on a log scale."""
    raw = span / ticks
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    m = raw / power
    return power * F.when(m >= 50**0.5, 10).when(m >= 10**0.5, 5).when(m >= 2**0.5, 2).otherwise(1)


def western(value: Column, digits: int) -> Column:
    """SC-56: 4,210,000.5 with a real minus sign."""
    return F.regexp_replace(F.format_number(value, digits), "^-", "−")


def indian(value: Column) -> Column:
    """SC-56: whole numbers grouped as 42,10,000."""
    n = F.abs(F.round(value, 0)).cast("decimal(38,0)").cast("string")
    grouped = F.regexp_replace(n, r"(\d)(?=(\d\d)*\d{3}$)", "$1,")
    return F.concat(F.when(F.round(value, 0) < 0, "−").otherwise(""), grouped)


def quantity(text: Column) -> Column:
    """SC-50, FLT-19: struct<status, value, decimals, kind, currency, scale, signed> of a printed number.

    status is null_marker, number or text. Brackets and a leading minus make it negative; % and x give the kind; a scale word
    multiplies nothing but is named, as the value is kept as printed.
    """
    t = F.trim(F.regexp_replace(text, "[\\u00A0\\u200B\\uFEFF]", " "))
    low = F.lower(t)
    body = r"^(\(?)\s*([-−+]?)\s*(₹|\$|€|£|rs\.?|inr|usd|eur|gbp)?\s*([-−+]?)\s*((?:\d{1,3}(?:,\d{2,3})+|\d+)(?:\.\d+)?|\.\d+)\s*(\)?)\s*(%|x|bps|crore|cr|lakh|million|mn|billion|bn|thousand|k)?\s*(\)?)[*†¹²³]*$"
    g = lambda i: F.regexp_extract(low, body, i)
    is_number = low.rlike(body)
    digits = F.regexp_replace(g(5), ",", "")
    minus = (g(1) == "(") | g(2).isin("-", "−") | g(4).isin("-", "−")
    unit = g(7)
    return F.struct(
        F.when(t.isNull() | low.isin(NULL_MARKS), "null_marker").when(is_number, "number").otherwise("text").alias("status"),
        F.when(is_number, F.when(minus, -digits.try_cast("double")).otherwise(digits.try_cast("double"))).alias("value"),
        F.when(is_number, F.length(F.regexp_extract(digits, r"\.(\d+)$", 1))).alias("decimals"),
        F.when(is_number, F.when(unit == "%", "percent").when(unit == "x", "ratio").when(unit == "bps", "bps").when((g(3) != "") | unit.isin(list(SCALES)), "amount").otherwise("plain")).alias("kind"),
        F.when(is_number, F.create_map(*[F.lit(x) for kv in CURRENCIES.items() for x in kv])[F.regexp_replace(g(3), r"\.$", "")]).alias("currency"),
        F.when(is_number & unit.isin(list(SCALES)), unit).alias("scale"),
        F.when(is_number, minus | g(2).isin("+") | g(4).isin("+")).alias("signed"),
    )


def stated_years(text: Column) -> Column:
    """SC-53: fiscal years named as FY24, FY2024, FY 2023-24, ascending, each once."""
    found = F.regexp_extract_all(F.upper(text), F.lit(r"FY\s*'?((?:\d{4}|\d{2})(?:\s*[-–/]\s*\d{2,4})?)(?!\d)"), F.lit(1))
    last = F.transform(found, lambda x: F.regexp_extract(x, r"(\d+)$", 1).cast("int"))
    return F.array_sort(F.array_distinct(F.transform(last, lambda y: F.when(y < 100, 2000 + y).otherwise(y))))


def dbfs(mean_square: Column, least: float = -90.0) -> Column:
    """SC-62: level in decibels of full scale."""
    return F.when(mean_square > 0, F.greatest(F.lit(least), 10 * F.log10(mean_square))).otherwise(least)


def between(noise: Column, low: float, high: float, at_low: float, at_high: float) -> Column:
    """SC-63: linear interpolation, clamped at both ends."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (noise - low) / (high - low)))
    return at_low + t * (at_high - at_low)
