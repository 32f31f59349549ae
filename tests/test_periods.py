"""The period finder against a plain reading of its forms, and against what is printed on the given tables."""

import calendar
import random
import re
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docloom.functions import periods as P
from docloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
NO_LETTER = r"(?<![^\W_])(?<![ऀ-ॿ])(?:%s)(?![^\W_])(?![ऀ-ॿ])"


def full(y):
    return int(y) if len(y) == 4 else int(y) + (2000 if int(y) < 70 else 1900)


def closing(y1, y2):
    first = full(y1)
    if not y2:
        return first
    second = int(y2) if len(y2) == 4 else first // 100 * 100 + int(y2)
    second += 100 * (second < first)
    if second != first + 1:
        raise ValueError
    return second


def month(name):
    name = name.rstrip(".").lower()
    return P.MONTHS.get(name) or P.MONTHS[name[:3]]


def end_of(y, m):
    return date(y, m, calendar.monthrange(y, m)[1])


def reading(kind, m):
    g, fy = m.groups(), lambda y: f"FY{y % 100:02}"
    if kind == "quarter_fy":
        y, n = closing(*g[1:3]), int(g[0])
        return f"Q{n} {fy(y)}", "quarter", end_of(y if n == 4 else y - 1, {1: 6, 2: 9, 3: 12, 4: 3}[n]), 3
    if kind == "half_fy":
        y = closing(*g[1:3])
        return f"H{g[0]} {fy(y)}", "half", date(y - 1, 9, 30) if g[0] == "1" else date(y, 3, 31), 6
    if kind == "nine_fy":
        y = closing(*g)
        return f"9M {fy(y)}", "nine_months", date(y - 1, 12, 31), 9
    if kind in ("fy", "fy_range"):
        y = closing(*g)
        return fy(y), "fy", date(y, 3, 31), 12
    if kind == "year_ended":
        d = date(int(g[2]), month(g[1]), int(g[0]))
        shown = f"{d.day} {calendar.month_abbr[d.month]} {d.year}"
        return (fy(d.year), "fy", d, 12) if d.month == 3 else (str(d.year) if d.month == 12 else f"YE {shown}", "year", d, 12)
    if kind == "quarter_cy":
        return f"Q{g[0]} {g[1]}", "quarter", end_of(int(g[1]), 3 * int(g[0])), 3
    if kind.startswith("date"):
        y, mo, d = {"date_dmy": (g[2], g[1], g[0]), "date_mdy": (g[2], g[0], g[1]), "date_iso": g, "date_num": (g[2], g[1], g[0])}[kind]
        d = date(int(y), int(mo) if mo.isdigit() else month(mo), int(d))
        return f"{d.day} {calendar.month_abbr[d.month]} {d.year}", "date", d, 0
    if kind == "month":
        e = end_of(full(g[1]), month(g[0]))
        return f"{calendar.month_abbr[e.month]} {e.year}", "month", e, 1
    if kind in ("cy", "year"):
        return str(full(g[0])), "year", date(full(g[0]), 12, 31), 12
    return f"{kind[0].upper()}{g[0]}", kind, None, 3 if kind == "quarter" else 6


def plain(text):
    """label, kind, end, months of the first form with a match that is a period."""
    text = re.sub(r"\s*(?:[¹²³*†‡]|\[\d+\])$", "", text or "").translate(str.maketrans(P.DEVANAGARI, "0123456789"))
    for kind, form in P.FORMS:
        for m in re.finditer(NO_LETTER % form, text, re.I):
            try:
                return reading(kind, m)
            except ValueError:
                continue
    return None


CASES = {
    "Revenue FY24": ("FY24", date(2024, 3, 31), 12, "Revenue"), "Revenue for the year ended 31 March 2024": ("FY24", date(2024, 3, 31), 12, "Revenue"), "3QFY24 profit": ("Q3 FY24", date(2023, 12, 31), 3, "profit"),
    "Q4 of FY 2023-24": ("Q4 FY24", date(2024, 3, 31), 3, ""), "H1 FY'25": ("H1 FY25", date(2024, 9, 30), 6, ""), "9M FY24 (unaudited)": ("9M FY24", date(2023, 12, 31), 9, "(unaudited)"), "1999-00 output": ("FY00", date(2000, 3, 31), 12, "output"),
    "as at 31.03.2024": ("31 Mar 2024", date(2024, 3, 31), 0, "as at"), "FY 2021-24": ("2021", date(2021, 12, 31), 12, "FY -24"), "31 Feb 2024": ("Feb 2024", date(2024, 2, 29), 1, "31"), "FY24*": ("FY24", date(2024, 3, 31), 12, ""), "Total (FY23)": ("FY23", date(2023, 3, 31), 12, "Total"),
    "वित्त वर्ष २०२३-२४ में आय": ("FY24", date(2024, 3, 31), 12, "में आय"), "20 सितंबर 2024": ("20 Sep 2024", date(2024, 9, 20), 0, ""), "Q2 sales": ("Q2", None, 3, "sales"), "2 Feb 2024, FY23": ("FY23", date(2023, 3, 31), 12, "2 Feb 2024"), "CY 95": ("1995", date(1995, 12, 31), 12, ""),
    "YE 30 June 2023": ("YE 30 Jun 2023", date(2023, 6, 30), 12, ""), "Q3 2021": ("Q3 2021", date(2021, 9, 30), 3, ""), "sep-19, net": ("Sep 2019", date(2019, 9, 30), 1, "net"), "xFY24": (None,) * 4, "24 meetings": (None,) * 4, "": (None,) * 4, None: (None,) * 4,
}


def found(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4)
    return {r.i: r for r in df.select("i", P.find_period(F.col("t")).alias("p"), P.period_label(P.find_period(F.col("t"))).alias("label")).collect()}


def test_stated_cases(spark):
    got = found(spark, list(CASES))
    for i, (text, want) in enumerate(CASES.items()):
        p = got[i].p
        assert (tuple(p[n] for n in ("label", "end", "months", "rest")) if p else (None,) * 4) == want, text


def test_against_a_plain_reading(spark):
    rng = random.Random(6)
    pieces = "FY fy F.Y. fiscal year 24 2024 2023-24 2023-25 99 1999 00 - – / ' ’ Q1 q4 3Q H2 9M nine months year ended ye 31 29 2 st th . , ( ) CY March mar Sept. feb may मार्च वित्त वर्ष ०४ 13 12 x é _ net for the of 31.03.2024 2024-02-30 2024-02-29 30/6/1999 \n".split(" ")
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 9))) for _ in range(2500)]
    got, hits = found(spark, texts), 0
    for i, t in enumerate(texts):
        p, want = got[i].p, plain(t)
        assert (p and (p.label, p.kind, p.end, p.months)) == want, repr(t)
        hits += want is not None
    assert hits > 1000


def test_labels_and_totals(spark):
    texts = ["FY24", "Full year FY24", "FY24 (recommended)", "31 Mar 2024", "Revenue FY24", "2009 (expanded 2023)", "Q1", "nothing"]
    got = found(spark, texts)
    assert [got[i].label for i in range(len(texts))] == [True, True, True, True, False, True, True, False]
    rows = spark.createDataFrame([("Full year FY24",), ("totals",), ("Total",), ("कुल आय",)], "t string").select(P.is_total_label(F.col("t")).alias("x")).collect()
    assert [r.x for r in rows] == [True, False, True, True]


@pytest.mark.skipif(not Path(SF).exists(), reason="the tables aren't here")
def test_lines_of_the_tables(spark):
    want = set()
    for name, key, column in (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("conversations", "conv_id", "text")):
        for r in spark.read.parquet(f"{SF}/{name}.parquet").collect():
            for i, line in enumerate((r[column] or "").split("\n")):
                if (p := plain(line)) is not None:
                    want.add((name, str(r[key]), r.turn if name == "conversations" else 0, i, *p))
    got = QUERIES["sc52_line_periods"](spark, SF).collect()
    assert {(r.part, r.key, r.turn, r.line, r.label, r.kind, r.end, r.months) for r in got} == want and len(got) == len(want) > 0
