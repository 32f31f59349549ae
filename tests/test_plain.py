"""Queries that SQL can't express, against plain Python over the same table."""

import random
import re
from collections import defaultdict
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import pytest

from docloom.plans import stream_queries, window_queries
from docloom.plans.queries import QUERIES
from docloom.streaming import steps as S

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the tables aren't here")


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def found(spark, name, *columns):
    return sorted((tuple(r[c] for c in columns) for r in QUERIES[name](spark, SF).collect()), key=str)


def plain_sentences(text):
    out, start = [], 0
    for m in re.finditer(r"[.!?।॥][\"')\]]*[ \t]+|\n+", text):
        last = text[start : m.start()].split()[-1:] or [""]
        if "\n" not in m[0] and (re.search(r"(?i)(?:^|\W)(?:rs|mr|dr|no|ltd|etc|e\.g|i\.e)$", last[0]) or re.search(r"(?:^|\W)[A-Z]$", last[0])):
            continue
        out.append((text[start : m.start()] + m[0].rstrip(" \t")).strip())
        start = m.end()
    return [x for x in [*out, text[start:].strip()] if x]


def test_sentences(spark):
    want = [(r.doc_id, i, s) for r in read(spark, "documents") if r.text for i, s in enumerate(plain_sentences(r.text))]
    assert found(spark, "sc16_sentences", "doc_id", "pos", "sentence") == sorted(want, key=str)


def test_tails(spark):
    want = []
    for r in read(spark, "conversations"):
        kept, used = [], 0
        for s in reversed(plain_sentences(r.text)):
            cost = int(np.ceil(len(s) / 3.5))
            if used + cost > 24:
                break
            kept, used = [s, *kept], used + cost
        flat = " ".join(r.text.split())
        words = flat if len(flat) <= 84 else (re.search(r"\s(\S.*)$", flat[-85:], re.S) or [None, ""])[1]
        want.append((r.conv_id, r.turn, " ".join(kept) or words))
    assert found(spark, "sc12_tails", "conv_id", "turn", "tail") == sorted(want, key=str)


def test_word_error_rate(spark):
    chats, want = defaultdict(list), []
    for r in read(spark, "conversations"):
        chats[r.conv_id].append((r.turn, r.text))
    for conv, turns in chats.items():
        turns.sort()
        for (_, a), (turn, b) in zip(turns, turns[1:], strict=False):
            a, b = a.split(), b.split()
            d = np.arange(len(b) + 1)
            for i, x in enumerate(a, 1):
                e = [i]
                for j, y in enumerate(b, 1):
                    e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (x != y)))
                d = e
            want.append((conv, turn, round(float(d[-1]) / len(a), 4) if a else None))
    got = [(c, t, None if w is None else round(w, 4)) for c, t, w in found(spark, "sc26_word_error_rate", "conv_id", "turn", "wer")]
    assert sorted(got, key=str) == sorted(want, key=str)


class Page(HTMLParser):
    OFF, BLOCK = {"script", "style", "nav", "footer", "header", "form", "aside", "title"}, set("p div h1 h2 h3 h4 h5 h6 li ul ol table tr td section article blockquote br".split())

    def __init__(self):
        super().__init__()
        self.off, self.blocks = [], [""]

    def handle_starttag(self, tag, attrs):
        if tag in self.OFF:
            self.off.append(tag)
        if tag in self.BLOCK:
            self.blocks.append("")

    def handle_endtag(self, tag):
        if self.off and self.off[-1] == tag:
            self.off.pop()
        if tag in self.BLOCK:
            self.blocks.append("")

    def handle_data(self, data):
        if not self.off:
            self.blocks[-1] += data


def test_page_text(spark):
    want = []
    for r in read(spark, "pages"):
        p = Page()
        p.feed(r.html or "")
        blocks = list(dict.fromkeys(b for b in (" ".join(x.split()) for x in p.blocks) if len(b) >= 40))
        want.append((r.page_id, len(blocks), "\n".join(blocks)))
    assert found(spark, "src13_page_text", "page_id", "blocks", "text") == sorted(want, key=str)


@pytest.mark.parametrize(
    ("name", "frame", "order", "step", "columns"),
    [
        ("st01_endpointing", stream_queries._frames, "frame_no", S.endpoint(), ("key", "frame_no", "event", "speech_ms", "silence_ms")),
        ("st04_noise_floor", stream_queries._frames, "frame_no", S.noise, ("key", "frame_no", "floor", "level")),
        ("st07_conversation_state", stream_queries._turns, "seq", S.conversation, ("key", "seq", "topic", "query", "cited", "language", "interrupted")),
    ],
)
def test_folds_deal_and_order_rows(spark, name, frame, order, step, columns):
    keys, want = defaultdict(list), []
    for r in frame(spark, SF).collect():
        keys[r.key].append(r)
    for rows in keys.values():
        state = None
        for r in [*sorted(rows, key=lambda r: r[order]), None]:
            state, out = step(state, r)
            want += out
    assert found(spark, name, *columns) == sorted(map(tuple, want), key=str)


def test_endpoints_by_hand():
    step = S.endpoint()

    def run(ps):
        state, out = None, []
        for i, p in enumerate(ps):
            state, rows = step(state, type("R", (), {"key": 1, "frame_no": i, "p": p})())
            out += [(r[1], r[2]) for r in rows]
        return out

    assert run([0.1, 0.6, *[0.9] * 9, *[0.1] * 19]) == [(1, "open"), (20, "pause"), (29, "close")]
    assert run([0.6, *[0.0] * 19]) == [(0, "open"), (10, "pause"), (19, "discard")]
    assert run([0.49] * 9) == [] and window_queries.budget(10, 0)(None, type("R", (), {"source": "a", "doc_id": 1, "n_chars": 700})())[0] == -190


def test_names_within_one_edit_meet_by_keys(spark, tmp_path):
    rng = random.Random(7)
    names = lambda n: [(i, rng.choice(["", "x", "n" + "".join(rng.choice("01") for _ in range(rng.randrange(0, 6))), None if i % 40 == 39 else "n7"]), i % 2) for i in range(n)]
    s, c = names(60), names(80)
    spark.createDataFrame(s, "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(c, "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    digits = lambda x: x.lstrip("nx")

    def near(a, b):
        return a == b or (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1) or any(len(x) == len(y) + 1 and y in [x[:i] + x[i + 1 :] for i in range(len(x))] for x, y in ((a, b), (b, a)))

    found = QUERIES["jn21_edit_distance"](spark, str(tmp_path))
    want = sorted((i, j) for i, a, k in s for j, b, m in c if k == m and a is not None and b is not None and near(digits(a), digits(b)))
    assert sorted(map(tuple, found.collect())) == want
    assert "levenshtein" not in found._jdf.queryExecution().toString()


def test_label_overlap_is_dealt_by_labels(spark, tmp_path):
    rows = [(i % 50, " ".join(("Red", "red", "blue", "tin")[j % 4] for j in range(i % 5)), f"B{i % 3}", ("RED TIN", "BLUE blue", "x")[i % 3]) for i in range(120)] + [(None, "red", "B0", None)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    said = {b: {w for _, _, c, t in rows if c == b and t for w in t.lower().split(" ")} for b in ("B0", "B1", "B2")}
    has = defaultdict(set)
    for key, name, _, _ in rows:
        has[key] |= set(name.lower().split(" "))
    found = QUERIES["jn18_label_overlap"](spark, str(tmp_path))
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()
    assert {(r.brand, r.p_partkey): r.shared for r in found.collect()} == {(b, k): len(w & s) for b, s in said.items() for k, w in has.items() if w & s}
