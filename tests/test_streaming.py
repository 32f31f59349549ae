from types import SimpleNamespace as Row

from docloom.streaming import steps as S
from docloom.streaming.stateful import sessions, stateful


def run(step, rows):
    state, out = None, []
    for r in [*rows, None]:
        state, got = step(state, r)
        out += got
    return out


def frames(ps):
    return [Row(key=1, frame_no=i, p=p, level=-50.0) for i, p in enumerate(ps)]


def test_endpoint_opens_pauses_and_closes():
    out = run(S.endpoint(), frames([0.1] * 10 + [0.9] * 10 + [0.1] * 20))
    assert [x[2] for x in out] == ["open", "pause", "close"] and out[0][1] == 10
    assert out[-1][3:] == (320, 608)


def test_endpoint_discards_a_click_and_keeps_a_dip():
    assert [x[2] for x in run(S.endpoint(), frames([0.9] * 2 + [0.1] * 30))] == ["open", "pause", "discard"]
    assert [x[2] for x in run(S.endpoint(), frames([0.9] * 10 + [0.4] * 5 + [0.9] * 5))] == ["open"]


def test_noise_floor_waits_then_follows():
    out = run(S.noise, [Row(key=1, frame_no=i, p=0.9, level=float(-i)) for i in range(40)])
    assert out[29][2] == -70.0 and out[31][2] == round(-31 * 0.8, 4)


def test_conversation_topic_moves_only_on_a_shift():
    row = lambda seq, **k: Row(**({"key": 1, "seq": seq, "intent": "question", "topic": None, "is_shift": False, "searched": False, "query": None, "cited": [], "completed": True, "asked_language": None} | k))
    out = run(S.conversation, [row(1, topic="a"), row(2, topic="b"), row(3, topic="c", is_shift=True, searched=True, query="q", cited=[4]), row(4, intent="acknowledgement", topic="d", is_shift=True, completed=False)])
    assert [x[2] for x in out] == ["a", "a", "c", "c"] and out[3][3:5] == ("q", "4") and out[3][6]


def test_chunker_starts_short_and_holds_markers():
    text = "Well, the total rose to 5 crore in the year. It was 4 before [S1]. And more words follow here"
    out = [x[2] for x in run(S.chunker, [Row(key=1, text=text[i : i + 7]) for i in range(0, len(text), 7)])]
    assert " ".join(out) == text and len(out[0].split()) <= 5 and not any("[" in c and "]" not in c for c in out)


def test_think_filter_across_pieces():
    pieces = ["a <th", "ink>secret", " more</thi", "nk> b <", "c"]
    assert "".join(x[2] for x in run(S.think_filter, [Row(key=1, seq=i, text=t) for i, t in enumerate(pieces)])) == "a  b <c"


def test_script_check_speaks_once():
    assert run(S.script_check, [Row(key=1, seq=i, text="ab" * 15) for i in range(4)]) == [(1, 1, "en")]


def test_stream_keeps_state_between_batches(spark, tmp_path):
    rows = [(k, i, 0.9 if 3 <= i < 15 else 0.1) for k in (1, 2) for i in range(40)]
    folder = tmp_path / "in"
    for part in (rows[:20] + rows[40:60], rows[20:40] + rows[60:]):
        spark.createDataFrame(part, "key long, frame_no long, p double").coalesce(1).write.mode("append").parquet(str(folder))
    schema = "key long, frame_no long, event string, speech_ms long, silence_ms long"
    stream = spark.readStream.schema("key long, frame_no long, p double").option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = stateful(stream, "key", ["frame_no"], S.endpoint(), schema).writeStream.format("memory").queryName("endpoints").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r)[:3] for r in spark.table("endpoints").collect())
    want = sorted(x[:3] for k in (1, 2) for x in run(S.endpoint(), [Row(key=k, frame_no=i, p=p) for kk, i, p in rows if kk == k]))
    assert got == want


def test_sessions_on_a_stream_drop_late_rows(spark, tmp_path):
    import datetime as d

    at = lambda m: d.datetime(2024, 1, 1) + d.timedelta(minutes=m)
    folder = tmp_path / "in"
    for part in ([(1, at(0), 1.0), (1, at(10), 2.0), (2, at(300), 1.0)], [(2, at(310), 1.0)], [(2, at(500), 1.0)], [(1, at(1), 5.0)], [(2, at(900), 1.0)]):
        spark.createDataFrame(part, "user_id long, ts timestamp, value double").coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema("user_id long, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = sessions(stream, "user_id", "ts", "30 minutes", late="60 minutes").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.user_id, r.n) for r in spark.table("sessions").collect()}
    assert {(1, 2), (2, 2), (2, 1)} <= got and (1, 3) not in got and (1, 1) not in got
