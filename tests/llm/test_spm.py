import random
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from docloom.llm import spm

TEXTS = ["", None, " ", "  a  b ", "x\ny\t é", "a　b ﬁ", "▁x ▁", "trail ", "dou  ble\n\n z", "一二 🎉🎉 \x00 ok", "don't 12345", "</s> <s> <unk> <0x41>", " " * 37 + "x", "ABC " * 5000, "ababab abab the then there"]


def message(fields):
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
            continue
        raw = value if isinstance(value, bytes) else None
        key, n, tail = (number << 3 | 2, len(raw), raw) if raw is not None else (number << 3, value, b"")
        for x in (key, n):
            while x > 127:
                out += bytes([x & 127 | 128])
                x >>= 7
            out += bytes([x])
        out += tail
    return out


def model_file(model_type, byte_fallback=1, dummy=1, squeeze=0):
    rng = random.Random(5)
    words = ["▁", "▁t", "▁th", "▁the", "he", "th", "e", "t", "h", "n", "r", "re", "en", "a", "b", "ab", "abab", "ba", "é", "▁a", "▁▁", "x", "▁re", "the"]
    pieces = [(b"<unk>", 0.0, 2), (b"<s>", 0.0, 3), (b"</s>", 0.0, 3)] + ([(f"<0x{i:02X}>".encode(), 0.0, 6) for i in range(256)] if byte_fallback else [])
    pieces += [(w.encode(), -float(i) - 1 if model_type == spm.BPE else -3 - rng.random() * 5, 1) for i, w in enumerate(words)]
    return message([*[(1, message([(1, p), (2, s), (3, k)])) for p, s, k in pieces], (2, message([(3, model_type), (4, len(pieces)), (35, byte_fallback)])), (3, message([(1, b"identity"), (3, dummy), (4, squeeze), (5, 1)]))])


def check(codec, data, texts):
    peer, whole = sentencepiece.SentencePieceProcessor(model_proto=data), spm.backend(codec.model)
    got = list(codec.encode(texts))
    for t, (ids, agrees) in zip(texts, got, strict=True):
        want = peer.encode(t or "")
        assert ids.tolist() == want and agrees, t
        assert whole.encode(t or "", add_special_tokens=False).ids == want, t
        assert codec.decode([ids])[0] == peer.decode(want), t


def random_texts(alphabet, n=300):
    rng = random.Random(6)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def test_public_model_agrees_with_sentencepiece():
    codec = spm.codec(spm.piece_model(), 2)
    check(codec, Path(spm.piece_model()).read_bytes(), [*TEXTS, *random_texts("abc the 12é日🎉 \n▁<>")])
    assert codec.simple and not codec.wrong


@pytest.mark.parametrize("model_type", [spm.UNIGRAM, spm.BPE])
@pytest.mark.parametrize(("byte_fallback", "dummy", "squeeze"), [(1, 1, 0), (0, 1, 0), (1, 0, 0), (1, 1, 1)])
def test_small_models(model_type, byte_fallback, dummy, squeeze):
    data = model_file(model_type, byte_fallback, dummy, squeeze)
    codec = spm.Codec(data)
    check(codec, data, random_texts("theabrnx é" + ("日" if byte_fallback else "")))
    assert codec.simple == (not squeeze)


def test_columns(spark):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS + ["again", "again"])], "doc_id long, text string, ids int")
    path = spm.piece_model()
    rows = df.withColumn("e", spm.encode(F.col("text"), path)).select("doc_id", "text", "e.agrees", F.col("e.ids").alias("i"), spm.decode(F.col("e.ids"), path).alias("back"), spm.checked(F.col("text"), path).alias("c")).collect()
    peer = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in rows:
        assert r.i == peer.encode(r.text or "") and r.agrees and r.back == peer.decode(r.i)
        assert r.c == (len(r.i), zlib.crc32(np.array(r.i, "<u4").tobytes()), True, r.back == (r.text or ""), zlib.crc32(r.back.encode()))
    empty = df.limit(0)
    assert empty.select(spm.checked(F.col("text"), path)).collect() == [] and empty.withColumn("e", spm.encode(F.col("text"), path)).collect() == []


def test_a_changed_normaliser_shows(monkeypatch):
    data = Path(spm.piece_model()).read_bytes()
    codec = spm.Codec(data)
    assert [a for _, a in codec.encode(["two  words ", "one"])] == [True, True]
    monkeypatch.setattr(codec, "segments", lambda text: [spm.MARK + w for w in text.split()])
    assert [a for _, a in codec.encode(["two  words ", "one"])] == [False, True] and codec.wrong == 1


def test_control_and_unknown_ids_decode():
    codec, peer = spm.codec(spm.piece_model()), sentencepiece.SentencePieceProcessor(model_file=spm.piece_model())
    ids = [1, *peer.encode("some words"), 0, 2]
    assert codec.decode([np.array(ids)]) == [peer.decode(ids)]


def test_ids_beyond_the_model():
    with pytest.raises(ValueError):
        spm.codec(spm.piece_model()).decode([np.array([40_000])])
