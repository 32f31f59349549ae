"""Labels, the guarded replacement and the gate of a noisy room on cases whose results are known."""

import random
import uuid
from types import SimpleNamespace as Row

from pyspark.sql import functions as F

from docloom.functions import labels as L
from docloom.functions.text import CHUNK_NAMESPACE, point_id
from docloom.operators.catalog import fact_coverage, replaced_if_present
from docloom.operators.windows import folded
from docloom.streaming import steps as S
from docloom.streaming.stateful import stateful


def test_pages_and_sections(spark):
    rows = [(2, None, "en", None), (2, 2, "en", "4. Travel > 4.2 Home"), (2, 3, "hi", " > "), (None, 3, None, "One"), (2, 3, None, "a >  > b ")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a int, b int, lang string, s string").orderBy("i")
    pages = lambda short: [r[0] for r in df.select(L.pages_label(F.col("a"), F.col("b"), F.col("lang"), short)).collect()]
    assert pages(False) == ["page 2", "page 2", "पृष्ठ 2–3", "", "pages 2–3"] and pages(True) == ["p. 2", "p. 2", "पृ. 2–3", "", "pp. 2–3"]
    assert [tuple(r) for r in df.select(L.section_label(F.col("s")), L.section_label(F.col("s"), short=False)).collect()] == [("", ""), ("§ 4.2 Home", "§ 4. Travel > 4.2 Home"), ("", ""), ("§ One", "§ One"), ("§ b", "§ a > b")]
    got = spark.createDataFrame([(["4.  Travel", " ", "4.2 Home"],), ([" "],), ([],), (None,)], "h array<string>").select(L.section_of(F.col("h"))).collect()
    assert [r[0] for r in got] == ["4. Travel > 4.2 Home", None, None, None]


def test_reference_labels(spark):
    rows = [("a.pdf", "T", False, 2, 3, "S"), ("a.docx", None, False, None, None, "4. Travel > 4.2 Home"), (None, None, False, None, None, None), ("x.com", " Share  price ", True, 1, 1, None), ("x.com", None, True, None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, f string, t string, w boolean, a int, b int, s string").orderBy("i")
    got = df.select(L.reference_label(F.col("f"), F.col("t"), F.col("w"), F.col("a"), F.col("b"), F.col("s"), F.lit("en"))).collect()
    assert [r[0] for r in got] == ["a.pdf, pp. 2–3", "a.docx, § 4.2 Home", "(unknown document)", "web: x.com — Share price", "web: x.com"]


def test_document_labels(spark):
    rows = [("kelmora_annual_report_fy24.pdf", "Kelmora Industries Limited"), ("kelmora_annual_report.pdf", "Annual Report"), ("dir/a.b-c.tar.gz", None), ("", "Only title"), (None, None), ("x.txt", ""), (".hidden", "Hidden")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, f string, t string").orderBy("i")
    got = [r[0] for r in df.select(L.document_label(F.col("f"), F.col("t"))).collect()]
    assert got == ["kelmora annual report fy24: Kelmora Industries Limited", "kelmora annual report", "a b c tar", "Only title", "", "x", "hidden"]
    split = spark.createDataFrame([("a b: c: d",), ("a b",), ("",)], "l string").select(L.split_document_label(F.col("l")).alias("x")).collect()
    assert [tuple(r.x) for r in split] == [("a b", "c: d"), ("a b", ""), ("", "")]


def test_document_titles(spark):
    item = "array<struct<text:string,label:string,level:int,page:int>>"
    docs = [[("Head", "h", 1, 2), ("First", "h", 1, 1), ("Real  title", "title", None, 3)], [("Late", "h", 1, 2), (" ", "h", 1, 1), ("Slide", "h", 2, 1)], [("text", "p", None, 1)], [("x" * 121, "title", None, 1), ("y", "title", None, 1)], [], [("No page", "h", 1, None)]]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], f"i int, items {item}").orderBy("i")
    assert [r[0] for r in df.select(L.document_title(F.col("items"))).collect()] == ["Real title", "Slide", None, None, None, "No page"]


def test_datasets_are_replaced_as_a_whole(spark):
    of = lambda rows, schema: spark.createDataFrame(rows, schema)
    full = "document_id long, version int, table_id int, body string"
    stored = of([(1, 1, 1, "a"), (1, 1, 9, "b"), (2, 1, 1, "c"), (3, 1, 1, "d"), (4, 1, 1, "e")], full)
    new = of([(1, 2, 1, "A"), (1, 2, 2, "B"), (2, 2, 1, "C"), (3, 1, 1, "D"), (3, 1, 7, "E"), (5, 1, 1, "F")], full)
    docs, tables = of([(1, 2), (2, 1), (3, 1), (4, 1)], "document_id long, version int"), of([(1, 2, 1), (1, 2, 2), (2, 2, 1), (3, 1, 1), (5, 1, 1), (3, 2, 7)], "document_id long, version int, table_id int")
    left, done = replaced_if_present(stored, new, docs, tables)
    assert sorted(map(tuple, left.collect())) == [(1, 2, 1, "A"), (1, 2, 2, "B"), (2, 1, 1, "c"), (3, 1, 1, "d"), (4, 1, 1, "e")]
    assert {(r.document_id, r.done) for r in done.collect()} == {(1, True), (2, False), (3, False), (5, False)}
    assert sorted(map(tuple, replaced_if_present(stored, new.limit(0), docs, tables)[0].collect())) == sorted(map(tuple, stored.collect()))


def room(*stretches):
    """Frames of (how many, probability, level)."""
    return [Row(key=1, frame_no=0, p=p, level=level) for n, p, level in stretches for _ in range(n)]


def events(frames):
    state, out, step = None, [], S.gated()
    for i, r in enumerate(frames):
        r.frame_no = i
        state, got = step(state, r)
        out += [(e[1], e[2]) for e in got]
    return out, state


def test_gate_holds_an_announcement_back():
    assert events(room((40, 0.1, -70.0), (7, 0.9, -30.0), (30, 0.1, -70.0)))[0] == [(65, "discard")]  # 224 ms of speech are too few
    out, state = events(room((40, 0.1, -70.0), (20, 0.9, -30.0), (30, 0.1, -70.0)))
    assert out == [(47, "announce"), (69, "pause"), (78, "close")] and state.user == -30.0
    assert events(room((40, 0.1, -70.0), (20, 0.9, -40.0), (30, 0.1, -70.0)))[0] == [(78, "discard")]  # far from the microphone
    assert events(room((40, 0.1, -70.0), (20, 0.9, -45.0), (30, 0.1, -70.0)))[0] == [(59, "discard")]  # so far that it doesn't even hold the turn


def test_gate_releases_once_near_speech_came():
    out, _ = events(room((40, 0.1, -70.0), (9, 0.9, -41.0), (12, 0.9, -25.0), (20, 0.1, -70.0)))
    assert out[0] == (51, "announce") and out[-1][1] == "close"  # the 80th percentile reaches the near field with the third loud frame


def test_gate_in_a_loud_room():
    loud = (200, 0.1, -35.0)
    assert events(room(loud, (20, 0.7, -20.0), (30, 0.1, -35.0)))[0] == []  # 0.7 opens nothing at this floor
    assert events(room(loud, (20, 0.9, -28.0), (30, 0.1, -35.0)))[0] == []  # too near the floor
    out, _ = events(room(loud, (20, 0.9, -20.0), (30, 0.9, -34.0)))
    assert [e for _, e in out] == ["announce", "pause", "close"] and out[0][0] == 212  # 400 ms are the least; babble at the floor is silence


def test_speakers_level_rises_fast_and_falls_slowly():
    once = lambda level: [(20, 0.9, level), (30, 0.1, -70.0)]
    assert events(room((40, 0.1, -70.0), *once(-30.0), *once(-20.0)))[1].user == -25.0
    assert events(room((40, 0.1, -70.0), *once(-20.0), *once(-26.0)))[1].user == -20.9


def test_gate_is_the_same_on_a_stream(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, i, rng.choice([0.05, 0.45, 0.9, 0.9, 0.9]) if i // 25 % 2 else 0.1, rng.uniform(-40, -15) if i // 25 % 2 else -70.0) for k in range(3) for i in range(400)]
    schema, out = "key long, frame_no long, p double, level double", "key long, frame_no long, event string, speech_ms long, silence_ms long, level double"
    for lo in (0, 150, 300):
        spark.createDataFrame([r for r in rows if lo <= r[1] < lo + 150], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stateful(stream, "key", ["frame_no"], S.gated(), out).writeStream.format("memory").queryName("gated").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = folded(spark.createDataFrame(rows, schema), "key", ["frame_no"], S.gated(), lambda: None, out).collect()
    assert sorted(map(tuple, spark.table("gated").collect())) == sorted(map(tuple, batch)) and len(batch) > 20


def test_point_ids(spark):
    names = ["7:v1:0000", "", "é:v2:0013", None] + [f"{i}:v1:{i:04}" for i in range(200)]
    got = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(point_id(F.col("n")).alias("p")).collect()
    assert [r.p for r in got] == [None if n is None else str(uuid.uuid5(uuid.UUID(CHUNK_NAMESPACE), n)) for n in names]


def test_fact_coverage(spark):
    facts = [(1, ["Net", "rose"], [2]), (2, ["net"], None), (3, ["net", "NET", "fell"], [9]), (4, [], [1]), (5, None, [1]), (6, ["rose", None], None), (7, ["rose", ""], None), (8, ["rose"], [])]
    chunks = [(10, "The NET rose", 1, 3), (11, "net fell", 4, None), (12, "rose. Net", None, None), (13, None, 1, 1), (14, "net rose", 3, 4)]
    got = fact_coverage(spark.createDataFrame(facts, "fact long, evidence array<string>, pages array<int>"), spark.createDataFrame(chunks, "chunk long, text string, page_start int, page_end int"))
    assert sorted(map(tuple, got.collect())) == [(1, 3, 2), (2, 4, 4), (3, 1, 0), (4, 0, 0), (5, 0, 0), (6, 0, 0), (7, 0, 0), (8, 3, 3)]


def test_a_section_may_be_shown_already(spark):
    df = spark.createDataFrame([("a.pdf", 2, 3, "§ x", "en"), ("a.pdf", None, None, "§ x", "en"), (None, None, None, "", "hi")], "f string, s int, e int, x string, l string")
    assert [r[0] for r in df.select(L.document_place(*map(F.col, "fsexl"))).collect()] == ["a.pdf, pp. 2–3", "a.pdf, § x", "(unknown document)"]
