"""Functions of answers, citations, messages and titles on cases whose results are known."""

import random
import re

from pyspark.sql import functions as F

from docloom.functions import chat as C
from docloom.functions import guard as G
from docloom.operators import answers as A
from docloom.operators.windows import folded
from docloom.streaming import steps as S
from docloom.streaming.stateful import stateful


def each(spark, f, values, schema="t string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}").select("i", f(F.col("t")).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


REPAIRS = {"rose 20.-4%": "rose 20.4%", "20-.4": "20.4", "1,,933 and 20..4": "1,933 and 20.4", "20. - 4": "20.4", "FY23-24, 3.5": "FY23-24, 3.5", "a..b": "a..b", "": "", "12, -3": "12,3"}


def test_numeral_repair(spark):
    assert each(spark, G.repaired, list(REPAIRS)) == list(REPAIRS.values())


def plain_facts(text):
    """The rule in plain Python, with the module's own lists."""
    text = re.sub(r"\[[^\]]*\]", " ", text)
    fall = re.compile(G.FALL.removeprefix("(?i)"), re.I)
    signed, unsigned = set(), set()
    for m in re.finditer(r"\d+(?:[.,]\d+)*", text):
        try:
            key = f"{float(m[0].replace(',', '')):.6f}".rstrip("0").rstrip(".")
        except ValueError:
            continue
        before, after = text[max(0, m.start() - 40) : m.start()], text[m.end() : m.end() + 25]
        minus = before[-1:] in tuple("-−–") and not before[-2:-1].isalnum()
        (signed if minus or before[-1:] == "(" and after[:1] == ")" or fall.search(before) or fall.search(after) else unsigned).add(key)
    return unsigned, signed


def test_number_facts_and_signs(spark):
    rng = random.Random(1)
    pieces = ["rose", "fell", "to", "21.0", "1,933", "-21.0", "(7)", "[S1 5]", "1.2.3", "by loss of", "x" * 30, "₹50", "8–9", "\n", "é", "no. 4"]
    texts = ["", "-5", "5"] + [" ".join(rng.choice(pieces) for _ in range(rng.randrange(0, 14))) for _ in range(200)]
    for t, r in zip(texts, each(spark, G.number_facts, texts), strict=True):
        assert (set(r.unsigned), set(r.signed)) == plain_facts(t), t
    a = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    cases = {"a margin of -21.0%": "a margin of 21.0%", "it fell -21%": "it fell -21%", "-7 and -21 and (-21)": "-7 and 21 and (21)", "a-21": "a-21", "": "", "none": "none"}
    assert each(spark, lambda t: G.unflipped(t, a("21"), a("8")), list(cases)) == list(cases.values())
    assert each(spark, lambda t: G.unflipped(t, a("21"), a("21")), ["of -21"]) == ["of -21"]
    assert each(spark, G.open_number, ["it is -21", "it is 20.", "₹7,", "end ", "word", "to -"]) == [6, 6, 0, 4, 4, 3]


def test_figures_without_a_source(spark):
    got = each(spark, lambda t: G.unsupported_figures(t, F.array(F.lit("1933"), F.lit("83.5"))), ["1,933 in 2024 and 83.50, 7 of 12", "FY24 [S12] 2023-24", "a 99.90 b"])
    assert got == [["12"], [], ["99.9"]]


def test_terms_periods_and_units(spark):
    t = each(spark, lambda t: G.terms(t, stated=True), ["Quarterly revenues in FY2023-24 were 1,933.50 (L3) [S1]", "on 31 March 2024; June 2022", "in 1999"])
    assert (t[0].periods, t[0].numbers, t[0].words) == ([24], ["1933.5", "24", "l3"], ["quarter", "revenue"])
    assert t[1].periods == [23, 24] and t[2].periods == [0, 99]
    table = "Plants 2.1\n| Name | Units |\n|---|---|\n| A | 5 |\n| B | 6 |\nAll is well. So 3."
    assert [re.sub(" +", " ", u).strip() for u in each(spark, lambda t: G.evidence_units(t, F.lit("5.1 Output")), [table])[0]] == [
        "Output Plants | Name | Units | | A | 5 |", "Output Plants | Name | Units | | B | 6 |", "Output Plants 2.1 All is well.", "Output So 3.",
    ]
    assert each(spark, lambda t: F.size(G.evidence_units(t, F.lit(""))), ["", "One. Two."]) == [0, 2]


DENIALS = {
    "Q4 revenue was 5 [S2], but the deck doesn't give FY23.": "Q4 revenue was 5 [S2].", "The documents do not give it.": None, "Sales rose; however the report, as filed, does not state margins.": None,
    "Revenue rose by a fifth in May; the report does not state margins.": "Revenue rose by a fifth in May.", "The report shows revenue does not include tax": None, "It is covered.": None,
}


def test_denials(spark):
    assert each(spark, G.not_covered, list(DENIALS)) == [True, True, True, True, False, False]
    got = each(spark, G.drop_denial, list(DENIALS))
    assert [got[i] for i in (0, 1, 3, 4, 5)] == [list(DENIALS.values())[i] for i in (0, 1, 3, 4, 5)]


ANSWER = "Sales were 1,9.-33 units [S1, S2]. Rs. 40 is from nowhere. So is 41! The report does not give sales. A margin of -21 held, but the report does not give sales of 1933. End"
SOURCES = ["Sales reached 19.33 units.", "A margin of 21 held with sales of 1933."]
WANT = [
    ("repaired", "Sales were 1,9.33 units [S1, S2]."), ("figure_replaced", "No."), ("figure_dropped", ""), ("dropped", ""), ("clause_dropped", "A margin of 21 held."), ("released", "End"),
]


def test_guard_in_a_batch_and_on_a_stream(spark, tmp_path):
    rng = random.Random(2)
    pieces, at = [], 0
    while at < len(ANSWER):
        n = rng.randrange(1, 9)
        pieces.append((7, len(pieces), ANSWER[at : at + n]))
        at += n
    schema = "key long, seq long, text string"
    sentences = folded(spark.createDataFrame(pieces, schema), "key", ["seq"], S.sentence_out, lambda: None, "key long, n long, sentence string")
    sources = spark.createDataFrame([(7, s) for s in SOURCES], "key long, text string")
    got = [(r.action, r.out) for r in A.guarded(sentences, sources, line="No.").orderBy("n").collect()]
    first = [("figure_replaced", "No."), ("figure_dropped", "")]
    assert got[0] in [WANT[0], first[0]] and got[3:] == WANT[3:] and got[2] == first[1]
    for i in (0, 1):
        spark.createDataFrame(pieces[i * len(pieces) // 2 : (i + 1) * len(pieces) // 2], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = stateful(stream, "key", ["seq"], S.sentence_out, "key long, n long, sentence string").writeStream.format("memory").queryName("sentences").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    out.awaitTermination()
    whole = [r.sentence for r in sentences.orderBy("n").collect()]
    assert [r.sentence for r in spark.table("sentences").orderBy("n").collect()] == whole[:-1] and whole[-1] == "End"


def test_sentence_ends():
    assert S.sentence_end("Rs. 5 is it. Next") == 12 and S.sentence_end("in the U.S. it") is None and S.sentence_end("1. one") is None
    assert S.sentence_end("18.2% of [S1. x] it") is None and S.sentence_end('He said "so." Then') == 13 and S.sentence_end("line\nnext") == 5


def test_languages_and_echoes(spark):
    cases = {"yeh kya hai": "hi", "batao": "hi", "the margin is high": "en", "मार्जिन क्या है": "hi", "EBITDA क्या": "hi", "123 ₹": None, "": None, "aap the best of the lot ever": "en"}
    assert each(spark, C.message_language, list(cases)) == list(cases.values())
    pairs = [("Valmora Industries.", "valmora industries, Zephyra", True), ("Valmora", "Valmora x", False), ("other words", "Valmora", False), ("a b", None, False), (None, "a", False)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, t string, p string, want boolean")
    assert all(r.e == r.want for r in df.select("want", C.echoes(F.col("t"), F.col("p")).alias("e")).collect())


def test_citations(spark):
    known = F.array(*[F.lit(x) for x in ("S1", "S2", "W2")])
    got = each(spark, lambda t: C.finalized(t, known), ["So [S1, w2] it is [S9]. And [s2; S9][S1].", "none", "", "[S7]", "[S01] x"])
    assert [(r.text, r.cited) for r in got] == [("So [S1][W2] it is. And [S2][S1].", ["S1", "W2", "S2"]), ("none", []), ("", []), ("", []), ("[S1] x", ["S1"])]
    assert each(spark, C.without_open_marker, ["18.2% [S", "x [S1]", "x [", ""]) == ["18.2%", "x [S1]", "x", ""]


def test_table_snippets(spark):
    got = each(spark, C.table_snippet, ["Lead | a | **b** | |---|:--| | 1 | 2 | | 3 | x\\|y | ", "| a | |---| | 1 |", "no table", "", "| a | b | |---|---| | 1 | 2 | | 3", "| a | b | | c | d |"])
    assert (got[0].lead, got[0].header, got[0].rows, got[0].truncated) == ("Lead", ["a", "b"], [["1", "2"], ["3", "x|y"]], False)
    assert got[1] is None and got[2] is None and got[3] is None and got[5] is None
    assert (got[4].rows, got[4].truncated) == ([["1", "2"]], True)


def test_respelling_and_spoken_forms(spark):
    renames = F.create_map(*[F.lit(x) for x in ("mora", "Valmora", "wall mora", "Valmora", "a.b", "AB")])
    assert each(spark, lambda t: C.respelled(t, renames), ["Wall Mora's and MORA, moral a.b axb", ""]) == ["Valmora's and Valmora, moral AB axb", ""]
    assert each(spark, C.spoken, ["**Net** ₹7,365 cr [S1] in FY24, up 5% vs. R&D", "₹50, e.g. FY 2023"]) == ["Net 7,365 crore rupees in fiscal year 24, up 5 percent versus R and D", "50 rupees, for example fiscal year 23"]


def test_titles_and_web_queries(spark):
    assert each(spark, C.clean_title, ["\n Title: “**FY24 margin**.”\nmore", "New chat", "", "# one two three four five six seven", "'x' [S1]!"]) == ["FY24 margin", None, None, "one two three four five six", "x"]
    long = "word " * 30
    assert each(spark, C.fallback_title, ["“What is it?” [S1]", "", long]) == ["What is it", None, ("word " * 12)[:-1][: 60 - 1].rsplit(" ", 1)[0] + "…"]
    df = spark.createDataFrame([("Compare margin of 21.5 with peers per the annual report a@b.co x.pdf FY24", "margin 21.5"), ("latest 99", ""), ("weather today", ""), ("margin 21.5 peers", "")], "t string, said string")
    assert [r.q for r in df.select(C.web_query(F.col("t"), F.col("said")).alias("q")).collect()] == ["Compare margin of 21.5 with peers FY24", None, "weather today", "margin peers"]


EDITS = {
    "Make it a line chart, please.": ("kind", "line", None), "turn that bar chart into a pie chart": ("kind", "donut", "bar"), "remove the table": ("remove", None, "table"), "clear the canvas": ("clear", None, None), "unpin the bar": ("unpin", None, "bar"),
    "pin it": ("pin", None, None), "show only FY24": ("only", None, None), "add FY23 too": ("periods", None, None), "add profit to that chart": ("model", None, None), "show revenue as a bar chart": None, "what is this?": None, "why a line": None, "": None, "hello there": None,
}



def test_chart_edits(spark):
    got = each(spark, C.parsed_edit, list(EDITS))
    assert [None if r is None else tuple(r) for r in got] == list(EDITS.values())
    assert each(spark, C.kind_mentions, ["a stacked bar chart and a line", "Bars or pie", "none"]) == [["stacked_bar", "line"], ["bar", "donut"], []]
    assert each(spark, lambda t: C.ordinal_before(t, "charts?|bars?"), ["the second chart", "the last red bar", "chart one"]) == [1, -1, None]


DENIED = [
    "The documents do not specify the margin.", "The report doesn't provide it.", "[S2] rose but does not give the FY23 split.", "It is not mentioned in the sources.", "There is no such information in the report.", "I couldn't find it.",
    "इस बारे में जानकारी नहीं दी गई है।", "यह विवरण नही है", "yeh uplabdh nahi hai",
]
STATED = ["The report shows revenue does not include other income.", "Revenue was not available online.", "No. 5 is about it.", "लाभ बढ़ा", "", "nahi uplabdh"]


def test_not_covered(spark):
    assert each(spark, G.not_covered, DENIED + STATED) == [True] * len(DENIED) + [False] * len(STATED)


def test_edits_in_hindi(spark):
    got = each(spark, C.parsed_edit, ["chart hata do", "सब हटा दो", "isko pie chart mein badlo", "sirf FY24 dikhao", "kitna hai"])
    assert [None if r is None else r.action for r in got] == ["remove", "clear", "kind", "only", None]


def test_figures_of_long_texts_in_time(spark):
    import time

    from docloom.functions.guard import number_facts

    df = spark.createDataFrame([("no figure " * 20_000 + "fell by 12", ), ("7 up", )] * 5, "t string").select(number_facts(F.col("t")).alias("f"))
    began = time.time()
    assert [(r.f.unsigned, r.f.signed) for r in df.collect()] == [([], ["12"]), (["7"], [])] * 5
    assert time.time() - began < 20


def test_sentences_are_folded_once_and_sources_may_be_dealt(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    said = ["It came to 5.", "The documents do not give sales.", "It fell in 2022.", "The report does not give sales in FY23."]
    schema = "key long, n long, sentence string"
    sentences = spark.createDataFrame([(k, i + 1, x) for k in range(20) for i, x in enumerate(said)], schema).mapInPandas(counted, schema)
    sources = spark.createDataFrame([(k, "Sales reached 5 in FY22." if k % 2 else "Costs were 7.") for k in range(20)], "key long, text string").repartition("key")
    for more in ({}, {"dealt": True}):
        before = seen.value
        got = {(r.key % 2, r.n): r.action for r in A.guarded(sentences, sources, **more).collect()}
        assert got == {(1, 1): "released", (1, 2): "dropped", (1, 3): "released", (1, 4): "released", (0, 1): "released", (0, 2): "released", (0, 3): "released", (0, 4): "released"}
        assert seen.value - before == 80


def test_cut_words_still_mark_figures(spark):
    # What stands before a figure is cut at 40 characters, which may leave a fall word of a longer one.
    texts = ["x sundown " + "y" * 34 + " 12", "sundown 12", "a (12)", "a 12 and 0.50 and 007", "12 lessons"]
    got = [(r.unsigned, r.signed) for r in each(spark, G.number_facts, texts)]
    assert got == [([], ["12"]), (["12"], []), ([], ["12"]), (["12", "0.5", "7"], []), (["12"], [])]
