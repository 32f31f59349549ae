import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from docloom.llm import packing

TEXTS = ["", None, "Hello  world\n\n x", "don't <|endoftext|> a\tb c ﬁ É é ́x", "word " * 9000, "12345 é$$$ ," * 700, "a", "a", "一二三 四五", " lead", "trail \n"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.word_tokenizer())


def check(rows, texts, tokenizer, capacity):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(range(len(texts)))
    for doc, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


@pytest.mark.parametrize("waiting", [2, 20_000])
def test_every_id_once_and_no_padding(spark, tokenizer, waiting):
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choice(["the", "erhat", "über", "x9"]) for _ in range(rng.randrange(1, 900))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(texts)], "doc_id long, text string, start string, length int").repartition(3)
    assert check(packing.pack(df, packing.word_tokenizer(), waiting=waiting).collect(), texts, tokenizer, 4096) == 0


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), packing.word_tokenizer()).collect() == []


def test_memo_equals_whole_texts(tokenizer):
    memo = packing.WordMemo(packing.separated(tokenizer, packing.SEPARATOR), most=2)
    texts = [*TEXTS, "a b c d", "c <|endoftext|> <|startoftext|>x d", "", "a a a", "<|", "x<|endoftext|>y", "Über. ÉA, x. !. a,. 1. 1, ×. ΑΣ. İ. <|ENDOFTEXT|> Don'T.\nX,Y, ß.\u00a0z"]
    for most in (1, 1 << 18):
        got = list(packing.texts_ids(memo, texts, most=most))
        assert [x.tolist() for x in got] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_fullest_is_best_subset():
    rng = random.Random(3)
    for _ in range(300):
        sizes = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 9))]
        room = rng.randrange(0, 90)
        counts = {s: sizes.count(s) for s in sizes}
        sums = {0}
        for s in sizes:
            sums |= {x + s for x in sums}
        chosen = packing.fullest(sorted(counts), counts.__getitem__, room)
        assert all(n <= counts[s] for s, n in chosen.items())
        assert sum(s * n for s, n in chosen.items()) == max(x for x in sums if x <= room)


def test_a_file_that_cuts_otherwise_is_refused():
    with pytest.raises(ValueError, match="another way"):
        packing.memo_for(packing.word_tokenizer().replace("word_bpe_49k", "byte_bpe_50k"))
