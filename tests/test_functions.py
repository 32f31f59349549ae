"""Small cases of the Column builders."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import numbers as N
from docloom.functions import text as T
from docloom.operators import catalog as C
from docloom.operators import evalmetrics as E
from docloom.operators import items as I
from docloom.operators import tables


def values(spark, build, rows, schema="t string"):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.x for r in df.select("i", build.alias("x")).orderBy("i").collect()]


def test_quantities(spark):
    got = values(spark, N.quantity(F.col("t")), ["₹ 4,21,000 crore", "12.5%¹", "(712)", "–", "n.a.", "1.2x", "about 5", "-$3.50", "45 bps", "1,234", ""])
    assert [(q.status, q.value, q.kind) for q in got] == [
        ("number", 421000.0, "amount"), ("number", 12.5, "percent"), ("number", -712.0, "plain"), ("null_marker", None, None), ("null_marker", None, None), ("number", 1.2, "ratio"), ("text", None, None), ("number", -3.5, "amount"),
        ("number", 45.0, "bps"), ("number", 1234.0, "plain"), ("null_marker", None, None),
    ]
    assert got[0].currency == "INR" and got[0].scale == "crore" and got[7].currency == "USD" and got[7].decimals == 2 and got[2].signed


def test_fiscal_dates(spark):
    rows = ["2024-03-31", "2024-04-01", "2023-12-31", "2024-01-01"]
    d = F.to_date("t")
    assert values(spark, N.fiscal_year(d), rows) == [2024, 2025, 2024, 2024]
    assert values(spark, N.fiscal_label(d, "quarter"), rows) == ["4QFY24", "1QFY25", "3QFY24", "4QFY24"]


def test_calculations_refuse_bad_bases(spark):
    rows = [(100.0, 112.5), (0.0, 5.0), (-1.0, 5.0)]
    assert values(spark, N.growth(F.col("a"), F.col("b")), rows, "a double, b double") == [12.5, None, None]
    assert values(spark, N.ratio(F.col("b"), F.col("a")), rows, "a double, b double") == [1.13, None, -5.0]


def test_indian_grouping(spark):
    assert values(spark, N.indian(F.col("v")), [421000.0, 12345678.0, -999.0, 1000.0], "v double") == ["4,21,000", "1,23,45,678", "−999", "1,000"]


def test_stated_years(spark):
    assert values(spark, N.stated_years(F.col("t")), ["FY24 and FY 2022-23", "in 2024", "fy2021"]) == [[2023, 2024], [], [2021]]


def test_normal_forms(spark):
    assert values(spark, T.collapsed(F.col("t")), ["a ​ b\n c ", "  "]) == ["a b c", ""]
    assert values(spark, T.answer_form(F.col("t")), ["₹4,21,000 at 12 %"]) == ["₹421000 at 12%"]
    assert values(spark, T.script_language(F.col("t")), ["राजस्व revenue", "plain", "123"]) == ["hi", "en", None]
    assert values(spark, T.slug(F.col("t"), 8), ["Net Profit (₹)", "!!!", "राजस्व"]) == ["net-prof", "item", "राजस्व"]


def test_sentences_keep_titles_and_initials(spark):
    assert values(spark, T.sentences(F.col("t")), ["Mr. Rao came. It cost rs. 5. Why? A. B. Roy\nnew line"]) == [["Mr. Rao came.", "It cost rs. 5.", "Why?", "A. B. Roy", "new line"]]


def test_tail_takes_whole_sentences(spark):
    assert values(spark, T.tail(F.col("t"), 6), ["One two three four. Five six. Seven.", "word " * 30]) == ["Five six. Seven.", "word word word word"]


def test_markers(spark):
    assert values(spark, T.markers(F.col("t")), ["a [s2] b [S1] c [w3][S2]"]) == [["S2", "S1", "W3"]]
    assert values(spark, T.without_markers(F.col("t"), F.array(F.lit("S1"))), ["a [s2] b [S1]."]) == ["a b [S1]."]


def test_backchannels(spark):
    assert values(spark, T.backchannel(F.col("t")), ["ok, hmm", "ok but why", "", "Thanks"]) == [True, False, True, True]
    assert values(spark, T.repeated(F.col("t")), ["no no no no", "go go", "aaaaah", "fine"]) == [True, False, True, False]


def test_url_keys(spark):
    assert values(spark, T.url_key(F.col("t")), ["https://www.A.com/x/?b=2&utm_s=1&a=1#f", "http://a.com/x", "http://a.com?ref=z"]) == ["a.com/x?a=1&b=2", "a.com/x", "a.com"]


def test_word_error_rate(spark):
    assert values(spark, E.word_error_rate(F.col("a"), F.col("b")), [("a b c d", "a x c"), ("a", ""), ("", "a"), ("a b", "a b")], "a string, b string") == [0.5, 1.0, None, 0.0]


def test_denials_and_figures(spark):
    assert values(spark, I.denial(F.col("t")), ["That is not covered.", "It rose, though not covered"]) == [True, False]
    assert values(spark, I.unsupported(F.col("t"), F.array(F.lit("1,200.50"))), ["1200.5 and 77 in 2021 by 3"]) == [["77"]]


def test_empty_scope_selects_nothing(spark):
    df = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "id int, project_id string")
    assert C.in_scope(df, "p").count() == 2 and C.in_scope(df, "p", []).count() == 0 and C.in_scope(df, "p", [2, 3]).count() == 1
    with pytest.raises(LookupError):
        C.point(df, "id", 9)


def test_recovery_queues_again(spark):
    df = spark.createDataFrame([(1, "RUNNING"), (2, "QUEUED")], "id int, state string")
    assert sorted(map(tuple, C.recovered(df, "id").collect())) == [(1, 0, "CANCELLED"), (1, 1, "QUEUED"), (2, 0, "QUEUED")]


def test_histogram_keeps_empty_buckets(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (99.0,)], "v double")
    assert [(r.bucket, r.n) for r in E.histogram(df, [], "v", [0, 5, 10, 20]).orderBy("bucket").collect()] == [(0, 1), (1, 1), (2, 1)]


def test_totals_nest(spark):
    df = spark.createDataFrame([(1, 1, i, v, 0) for i, v in enumerate([10.0, 20.0, 30.0, 5.0, 6.0, 11.0])], "table_id long, col int, row int, value double, decimals int")
    assert [r.is_total for r in tables.totals(df).orderBy("row").collect()] == [False, False, True, False, False, True]


def test_intents_by_words_of_ascii_letters(spark):
    rows = ["Doó ciónado", "do it", "dos it", "xshow it", "show it", "éshow it", "livé news", "Is that so?\n", "That is so?\u2028", "No, that", "ñno, that", "did_it"]
    assert values(spark, T.intent(F.col("t")), rows) == ["question", "question", "statement", "statement", "visual", "visual", "live", "question", "statement", "correction", "correction", "statement"]
