"""Reporting periods in free text (SC-52): FY24, Q3 FY24, the year ended 31 March 2024, 31.03.2024, Mar 2024, Q1, and how long each lasts.

Forms are tried in a fixed order, and the first form with a match that is a date counts, not the leftmost match: "2 Feb 2024, FY23" is FY23.
A fiscal year ends in March. A match that is no date (31 Feb, month 13, FY 2021-24) is passed over. Everything is a Column, so a text with no
digit costs one test. Not done: composed and decomposed letters aren't unified (Spark has no NFC).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.items import footnote_split
from .text import collapsed

# Month names, words for a fiscal year, and the printed forms of a period, in the order in which they are tried.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "जनवरी": 1, "फ़रवरी": 2, "फरवरी": 2, "मार्च": 3, "अप्रैल": 4, "मई": 5, "जून": 6, "जुलाई": 7, "अगस्त": 8, "सितंबर": 9, "सितम्बर": 9, "अक्टूबर": 10, "अक्तूबर": 10,
    "नवंबर": 11, "नवम्बर": 11, "दिसंबर": 12, "दिसम्बर": 12,
}
MONTH = (
    r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
    "|जनवरी|फ़रवरी|फरवरी|मार्च|अप्रैल|मई|जून|जुलाई|अगस्त|सितंबर|सितम्बर|अक्टूबर|अक्तूबर|नवंबर|नवम्बर|दिसंबर|दिसम्बर)\\.?"
)
FY = r"(?:fy|f\.y\.|fiscal(?:\s+year)?|financial\s+year|वित्त(?:ीय)?\s+वर्ष|वि\.\s?व\.)"
YEAR4, DAY = "((?:19|20)[0-9]{2})", "([0-9]{1,2})"
YEARS = r"((?:19|20)[0-9]{2}|[0-9]{2})(?:\s*[-–/]\s*((?:19|20)[0-9]{2}|[0-9]{2}))?"
FORMS = (
    ("quarter_fy", rf"(?:q|quarter\s*)([1-4])\s*['’]?\s*(?:of\s+)?{FY}\s*['’]?\s*{YEARS}"),
    ("quarter_fy", rf"([1-4])q\s*{FY}\s*['’]?\s*{YEARS}"),
    ("half_fy", rf"(?:h|half\s*)([12])\s*['’]?\s*{FY}\s*['’]?\s*{YEARS}"),
    ("nine_fy", rf"(?:9m|9\s*months|nine\s+months)\s*{FY}\s*['’]?\s*{YEARS}"),
    ("year_ended", rf"(?:(?:for\s+the\s+)?year\s+ended|ye)\s+{DAY}(?:st|nd|rd|th)?\s+{MONTH}[\s,]*{YEAR4}"),
    ("fy", rf"{FY}\s*['’]?\s*{YEARS}"),
    ("quarter_cy", rf"q([1-4])\s*(?:cy\s*)?{YEAR4}"),
    ("date_dmy", rf"{DAY}(?:st|nd|rd|th)?[\s.\-/]*{MONTH}[\s.,\-/']*{YEAR4}"),
    ("date_mdy", rf"{MONTH}\s+{DAY}(?:st|nd|rd|th)?,?\s+{YEAR4}"),
    ("date_iso", rf"{YEAR4}-([0-9]{{2}})-([0-9]{{2}})"),
    ("date_num", rf"{DAY}[./]([0-9]{{1,2}})[./]{YEAR4}"),
    ("fy_range", rf"{YEAR4}\s*[-–/]\s*((?:19|20)?[0-9]{{2}})"),
    ("month", rf"{MONTH}[\s\-'’,]*((?:19|20)[0-9]{{2}}|[0-9]{{2}})"),
    ("cy", r"cy\s*['’]?\s*((?:19|20)[0-9]{2}|[0-9]{2})"),
    ("year", YEAR4),
    ("quarter", "q([1-4])"),
    ("half", "h([12])"),
)
CONNECTORS = r"in|for|of|during|the|as\s+at|as\s+on|ended|ending|year", r"in|for|of|during|the|as\s+at|as\s+on"
REMARK = (
    r"(?iu)^(?:full\s+year|year|total|annual|quarter(?:\s+ended)?|half\s+year|as\s+at|as\s+on|year\s+ended|ended|actual|audited|unaudited|reported|recommended"
    r"|provisional|estimated|est\.?|e|a|p|पूर्ण\s+वर्ष|वर्ष|कुल)?\z"
)
TOTAL = r"(?iu)(?<![\p{L}\p{N}_])(?:full\s+year|total|annual|पूर्ण\s+वर्ष|कुल)(?![\p{L}\p{N}_])"
DEVANAGARI, SHORT_MONTHS = "०१२३४५६७८९", "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec"
# End of fixed values. A form stands alone: no letter, digit or Devanagari sign on either side.
ALONE = r"(?iu)(?<![\p{L}\p{N}ऀ-ॿ])(?:%s)(?![\p{L}\p{N}ऀ-ॿ])"
PATTERNS = tuple((kind, ALONE % form) for kind, form in FORMS)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed, and written down, once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _int(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("int")


def _full_year(text: Column) -> Column:
    """24 is 2024, 70 is 1970; null for the empty string."""
    return let(_int(text), lambda y: F.when(y >= 100, y).when(y < 70, 2000 + y).otherwise(1900 + y))


def _fiscal_end(first: Column, second: Column) -> Column:
    """The year in which "FY24", "2023-24" or "1999-00" ends; null if the two years don't follow each other."""
    written = lambda y1: F.when(F.length(second) == 4, _int(second)).otherwise(F.floor(y1 / 100).cast("int") * 100 + _int(second))
    ends = lambda y1: let(written(y1), lambda y2: F.when(second == "", y1).when(F.when(y2 < y1, y2 + 100).otherwise(y2) == y1 + 1, y1 + 1))
    return let(_full_year(first), ends)


def _date(year: Column, month: Column, day: Column) -> Column:
    """The date, or null where there is none."""
    return F.format_string("%04d-%02d-%02d", year, month, day).try_cast("date")


def _month(text: Column) -> Column:
    low = F.lower(F.rtrim(text, F.lit(".")))
    names = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return F.coalesce(F.element_at(names, low), F.element_at(names, F.left(low, F.lit(3))))


def _fy(year: Column) -> Column:
    return F.format_string("FY%02d", year % 100)


def _day_label(d: Column) -> Column:
    return F.concat_ws(" ", F.day(d).cast("string"), F.element_at(F.split(F.lit(SHORT_MONTHS), " "), F.month(d)), F.year(d).cast("string"))


def _period(kind: str, label: Column | Callable[[Column], Column], end: Column, months: int) -> Column:
    """label: a Column, or what makes it of the end."""
    granularity = {"fy": "year"}.get(kind, kind)
    one = lambda e: F.struct((label(e) if callable(label) else label).alias("label"), F.lit(kind).alias("kind"), e.alias("end"), F.lit(months).alias("months"), F.lit(granularity).alias("granularity"))
    return let(end, lambda e: F.when(e.isNotNull(), one(e)))


def _fiscal(part: str, group: Callable[[int], Column], at: int) -> Column:
    """A fiscal year or a part of it; its years are the groups from `at` on, its number the first."""
    n, last = _int(group(1)), lambda y, m: F.last_day(_date(y, m, F.lit(1)))

    def of(year: Column) -> Column:
        if part == "fy":
            return _period("fy", _fy(year), last(year, F.lit(3)), 12)
        if part == "nine":
            return _period("nine_months", F.concat(F.lit("9M "), _fy(year)), last(year - 1, F.lit(12)), 9)
        if part == "half":
            return _period("half", F.concat(F.lit("H"), group(1), F.lit(" "), _fy(year)), last(year - F.when(n == 1, 1).otherwise(0), F.when(n == 1, 9).otherwise(3)), 6)
        return _period("quarter", F.concat(F.lit("Q"), group(1), F.lit(" "), _fy(year)), last(year - F.when(n == 4, 0).otherwise(1), F.when(n == 4, 3).otherwise(n * 3 + 3)), 3)

    return let(_fiscal_end(group(at), group(at + 1)), of)


def _ended(end: Column) -> Column:
    label = lambda e: F.when(F.month(e) == 12, F.year(e).cast("string")).otherwise(F.concat(F.lit("YE "), _day_label(e)))
    return let(end, lambda e: F.when(F.month(e) == 3, _period("fy", _fy(F.year(e)), e, 12)).otherwise(_period("year", label, e, 12)))


def _unanchored(kind: str, letter: str, n: Column, months: int) -> Column:
    return F.struct(F.concat(F.lit(letter), n).alias("label"), F.lit(kind).alias("kind"), F.lit(None).cast("date").alias("end"), F.lit(months).alias("months"), F.lit(kind).alias("granularity"))


def _built(kind: str, pattern: str, hit: Column) -> Column:
    """The period that a match of a form says, or null. The form matches its own match whole, so its groups can be read from that."""
    g = lambda i: F.regexp_extract(hit, pattern, i)
    day = lambda d: _period("date", _day_label, d, 0)
    if kind in ("quarter_fy", "half_fy"):
        return _fiscal(kind.removesuffix("_fy"), g, 2)
    if kind in ("nine_fy", "fy", "fy_range"):
        return _fiscal("nine" if kind == "nine_fy" else "fy", g, 1)
    if kind == "year_ended":
        return _ended(_date(_int(g(3)), _month(g(2)), _int(g(1))))
    if kind == "quarter_cy":
        return _period("quarter", F.concat_ws(" ", F.concat(F.lit("Q"), g(1)), g(2)), F.last_day(_date(_int(g(2)), 3 * _int(g(1)), F.lit(1))), 3)
    if kind == "date_dmy":
        return day(_date(_int(g(3)), _month(g(2)), _int(g(1))))
    if kind == "date_mdy":
        return day(_date(_int(g(3)), _month(g(1)), _int(g(2))))
    if kind in ("date_iso", "date_num"):
        return day(_date(_int(g(1 if kind == "date_iso" else 3)), _int(g(2)), _int(g(3 if kind == "date_iso" else 1))))
    if kind == "month":
        end = F.last_day(_date(_full_year(g(2)), _month(g(1)), F.lit(1)))
        return _period("month", lambda e: F.concat_ws(" ", F.element_at(F.split(F.lit(SHORT_MONTHS), " "), F.month(e)), F.year(e).cast("string")), end, 1)
    if kind in ("cy", "year"):
        year = _full_year(g(1))
        return _period("year", lambda e: F.year(e).cast("string"), _date(year, F.lit(12), F.lit(31)), 12)
    return _unanchored("quarter", "Q", g(1), 3) if kind == "quarter" else _unanchored("half", "H", g(1), 6)


def _first_of(text: Column, kind: str, pattern: str) -> Column:
    """struct<period, before, after>: the first match of one form that is a period, with the text on either side; null if there is none."""
    one = lambda h, i: F.struct(_built(kind, pattern, h).alias("period"), i.alias("at"), h.alias("hit"))

    def sides(hits: Column, x: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        before = F.array_join(F.flatten(F.zip_with(F.slice(gaps, 1, x["at"] + 1), F.slice(hits, 1, x["at"]), lambda a, b: F.array_compact(F.array(a, b)))), "")
        cut = lambda b: F.struct(x["period"].alias("period"), b.alias("before"), F.substring(text, F.length(b) + F.length(x["hit"]) + 1, F.length(text)).alias("after"))
        return F.when(x.isNotNull(), let(before, cut))

    first = lambda hits: let(F.get(F.filter(F.transform(hits, one), lambda x: x["period"].isNotNull()), F.lit(0)), lambda x: sides(hits, x))
    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), first))


def _tidied(rest: Column) -> Column:
    """What is left of a label: no empty brackets, and no connecting words or marks at its ends."""
    first, last = CONNECTORS
    rest = F.regexp_replace(rest, r"\(\s*\)", "")
    rest = F.regexp_replace(rest, rf"(?iu)^(?:(?:{first})\s+|[ ,:;–-]+)+", "")
    rest = F.regexp_replace(rest, rf"(?iu)(?:\s+(?:{last})|[ ,:;–-]+)+\z", "")
    return collapsed(F.regexp_replace(rest, r"\s+([,.;:])", "$1"))


def find_period(text: Column) -> Column:
    """SC-52: struct<label, kind, end, months, granularity, rest>: the period that a text states, and the text without it; null if it states none.

    Null and empty texts, and texts without a digit, state none; an unanchored Q1 or H2 has no end."""

    def whole(t: Column) -> Column:
        found = F.coalesce(*[_first_of(t, kind, pattern) for kind, pattern in PATTERNS])
        names = ("label", "kind", "end", "months", "granularity")
        rest = lambda x: _tidied(collapsed(F.concat_ws(" ", x["before"], x["after"]))).alias("rest")
        return F.transform(F.array(found), lambda x: F.when(x.isNotNull(), F.struct(*[x["period"][n].alias(n) for n in names], rest(x))))

    plain = F.translate(footnote_split(text)[0], DEVANAGARI, "0123456789")
    return F.when(text.rlike("[0-9०-९]"), F.get(F.flatten(F.transform(F.array(plain), whole)), F.lit(0)))


def period_label(found: Column) -> Column:
    """Whether a text with this find_period is nothing but a period label: the rest is a known remark, beside what stands in brackets."""
    rest = F.regexp_replace(F.regexp_replace(found["rest"], r"\([^)]*\)", ""), r"^[ ,:;–-]+|[ ,:;–-]+\z", "")
    return F.coalesce(rest.rlike(REMARK), F.lit(False))


def is_total_label(text: Column) -> Column:
    """The sum of the periods above it ("Full year FY24"), not one more of them."""
    return text.rlike(TOTAL)
