import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docloom.llm import packing, rans
from docloom.llm.queries import QUERIES


def coded(ids, every=rans.EVERY):
    t = rans.frequencies(np.bincount(ids))
    return t, rans.encoded(np.array(ids, np.uint32), t, every)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000)), min_size=1, max_size=3000), st.integers(1, 40))
def test_round_trip(ids, every):
    t, block = coded(ids, every)
    assert int(t.freq.sum()) == 1 << rans.SCALE_BITS and t.freq.min() >= 1
    back = rans.unpacked(rans.packed(t))
    assert all((a == b).all() for a, b in zip(t, back, strict=True))
    assert rans.Block(block).ids(back, rans.slots_of(back)).tolist() == ids


def test_checkpoints_decode_alone_and_size_is_near_the_entropy():
    rng = np.random.default_rng(4)
    ids = (rng.zipf(1.4, 600_000) % 49_408).astype(np.uint32)
    t, block = coded(ids, 64)
    b, step = rans.Block(block), rans.Block(block).lanes * 64
    assert len(b.sums) == -(-len(ids) // step) > 5
    for mark in (len(b.sums) - 1, 3, 0):
        assert (b.decoded(mark, t, rans.slots_of(t)) == ids[mark * step : (mark + 1) * step]).all()
    p = np.bincount(ids)
    bits = -(p[p > 0] * np.log2(p[p > 0] / len(ids))).sum()
    plain = rans.encoded(ids, t)
    assert bits / 8 < len(plain) < bits / 8 * 1.01 + 16 * rans.LANES + 1000


@pytest.mark.parametrize("at", [0, 7, 40, -100, -1])
def test_damage_raises(at):
    t, block = coded(list(range(2000)) * 3)
    broken = bytearray(block)
    broken[at] ^= 1
    with pytest.raises(ValueError):
        rans.Block(bytes(broken)).ids(t, rans.slots_of(t))


def test_wrong_table_raises():
    _, block = coded([1, 2, 3] * 100)
    other, _ = coded([1, 2, 3, 3] * 100)
    with pytest.raises(ValueError):
        rans.Block(block).ids(other, rans.slots_of(other))


TEXTS = ["", None, 'a "quoted" text', "same", "same", "漢字 é <|endoftext|> x", "word " * 30_000]


def table(spark, tmp_path, rows):
    spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, shard int, part string, found int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def plain(rows):
    tokenizer, start, out = Tokenizer.from_file(packing.word_tokenizer()), 0, []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_whole_texts(spark, tmp_path):
    rng = random.Random(5)
    texts = TEXTS + [" ".join(rng.choice(["the", "erhat", "über", "x9"]) for _ in range(rng.randrange(1, 900))) for _ in range(200)]
    rows = [(None, "no id"), *((3 * i - 20, t) for i, t in enumerate(texts))]
    found = QUERIES["op12_rans"](spark, table(spark, tmp_path, rng.sample(rows, len(rows)))).collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == plain(rows)


def test_small_groups_and_repeated_ids(spark, tmp_path):
    rows = [(i // 3, f"text {'ab ' * (i % 7)}{i % 5}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    rans.write(docs, f"{tmp_path}/ids", packing.word_tokenizer(), group_ids=50, block_ids=16)
    got = sorted(rans.read(spark, f"{tmp_path}/ids", ids=True).collect(), key=lambda r: r.start)
    tokenizer = Tokenizer.from_file(packing.word_tokenizer())
    assert [r.doc_id for r in got] == [i // 3 for i in range(300)] and [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    want = sorted((i, tuple(tokenizer.encode(t, add_special_tokens=False).ids) + (1,)) for i, t in rows)
    assert sorted((r.doc_id, tuple(r.ids)) for r in got) == want
    assert spark.read.parquet(f"{tmp_path}/ids").count() > 20


def test_empty_table(spark, tmp_path):
    assert QUERIES["op12_rans"](spark, table(spark, tmp_path, [])).collect() == []
