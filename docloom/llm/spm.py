"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed as protobuf: pieces with scores and kinds, the trainer's model type and byte fallback, and the
normaliser's character map and white-space rules. From these a tokenizers pipeline is rebuilt: normaliser, space marker, a Unigram
model from the scores or a BPE model whose merges are ordered by the scores of what they make, byte fallback, and decoder. Where
no piece holds the marker behind another character, which parsing checks, segments that begin at a marker are encoded apart, so
each distinct segment of a batch is encoded once, by encode_batch on `threads` threads; otherwise whole texts are. Every whole text is
also encoded by the SentencePiece library with the model file as it is, so a difference in normaliser, segmentation or model shows with
its document, and the ids of every document are decoded as a whole.

Defined cases: null texts have no ids (like empty ones) and decode to an empty text; control pieces in a text are ordinary text;
rows are encoded one by one, so repeated rows get the same ids; texts of any length are encoded whole; decoding ids that aren't in the
model raises; other columns pass through.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import by_parts, slices
from .packing import WordMemo

MARK = "▁"
# Piece kinds and model types of the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Segments that a worker remembers, bytes of text that it handles at once, rows of a batch that go together, and threads that encode and decode a batch.
MEMO_SEGMENTS, LOOKUP_BYTES, BATCH_ROWS, THREADS = 500_000, 1 << 21, 2048, 2
#: Segments that are encoded as one text.
TOGETHER = 256
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def protobuf(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) pairs of a message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass(frozen=True)
class Model:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    type: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool
    escape: bool

    @property
    def separable(self) -> bool:
        """No piece holds the marker behind another character."""
        return self.escape and not any(MARK in p.lstrip(MARK) for p, k in zip(self.pieces, self.kinds, strict=True) if k in (NORMAL, USER))


def parse(data: bytes) -> Model:
    pieces, trainer, normalizer = [], {}, {}
    for number, value in protobuf(data):
        if number == 1:
            f = dict(protobuf(value))
            pieces.append((f[1].decode("utf-8"), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(protobuf(value))
        elif number == 3:
            normalizer = dict(protobuf(value))
    names, scores, kinds = (list(x) for x in zip(*pieces, strict=True))
    model = Model(names, scores, kinds, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normalizer.get(2, b""), bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)), bool(normalizer.get(5, 1)))
    if model.type not in (UNIGRAM, BPE) or trainer.get(24, 0):
        raise ValueError("only unigram and BPE models with the marker before words are supported")
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """Every split of a normal piece into two normal pieces, best piece first."""
    known = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k in (NORMAL, USER)}
    out = []
    for piece, i in known.items():
        for cut in range(1, len(piece)):
            a, b = known.get(piece[:cut]), known.get(piece[cut:])
            if a is not None and b is not None:
                out.append((-model.scores[i], i, a, b, piece[:cut], piece[cut:]))
    return [x[4:] for x in sorted(out)]


def backend(model: Model, whole: bool = True, lossless: bool | None = None):
    """The tokenizers pipeline; with whole=False, for segments that are normalised and marked already. lossless: ids hold no unknown piece, as encoding with byte fallback gives none."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = model.kinds.index(UNKNOWN)
    vocabulary = {p: i for i, p in enumerate(model.pieces)}
    if model.type == BPE:
        core = models.BPE(vocab=vocabulary, merges=merges(model), unk_token=model.pieces[unknown], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        lowest = min(s for s, k in zip(model.scores, model.kinds, strict=True) if k == NORMAL)
        core = models.Unigram([(p, s if k == NORMAL else lowest - 100.0) for p, s, k in zip(model.pieces, model.scores, model.kinds, strict=True)], unk_id=unknown, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    if whole:
        steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
        if model.squeeze:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if model.escape:
            steps.append(normalizers.Replace(" ", MARK))
        if model.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if model.escape else " "))
        tokenizer.normalizer = normalizers.Sequence(steps)
        if model.separable:
            tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(SEGMENT.pattern), "isolated")
        users = [AddedToken(p, normalized=False, special=False) for p, k in zip(model.pieces, model.kinds, strict=True) if k == USER]
        if users:
            tokenizer.add_tokens(users)
    lost = [] if (model.byte_fallback if lossless is None else lossless) else [decoders.Replace(model.pieces[unknown], " \u2047 ")]
    strip = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([*lost, decoders.ByteFallback(), decoders.Fuse(), decoders.Replace(MARK, " "), *strip])
    return tokenizer


class Codec:
    """Encoder and decoder of one model in one Python worker."""

    def __init__(self, data: bytes, threads: int = THREADS):
        import sentencepiece

        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.threads = threads
        self.model = parse(data)
        self.simple = self.model.separable and not self.model.charsmap and not self.model.squeeze and USER not in self.model.kinds
        self.tokenizer = backend(self.model, whole=not self.simple)
        self.peer = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.wrong = 0  # texts on which the libraries differed
        self.memo = WordMemo(self._learn, MEMO_SEGMENTS)
        self.opens = np.array([p.startswith(MARK) for p in self.model.pieces]) & (MARK in self.model.pieces)
        self.silent = np.array([k == CONTROL for k in self.model.kinds])

    def _batch(self, texts: list, **kw) -> list[list[int]]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if self.threads > 1 else "false"
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False, **kw)]

    def _learn(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments, each a word of its own: those with one marker at the front begin at the only piece that begins with it."""
        one = self.opens.any() and all(s[0] == MARK != s[1:2] for s in segments)
        ids = self._batch([segments[i : i + TOGETHER] for i in range(0, len(segments), TOGETHER)], is_pretokenized=True) if one else self._batch(segments)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        return flat, np.diff(np.flatnonzero(self.opens[flat]), append=len(flat)) if one else sizes

    def segments(self, text: str) -> list[str]:
        """The stretches from marker to marker of a text."""
        return SEGMENT.findall((MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)) if text else []

    def _by_segments(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text. Where single spaces separate all words Arrow finds the segments, elsewhere a regular expression."""
        odd = pc.or_(pc.match_substring_regex(texts, f"^$|^ |  | $|{MARK}"), not self.model.dummy_prefix)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        words = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        rest = pa.array([self.segments(t) for t in texts.filter(odd).to_pylist()], pa.large_list(pa.large_string()))
        for rows, own, lead in ((pc.invert(odd), words, MARK), (odd, rest, "")):
            counts = np.asarray(pc.list_value_length(own)).astype(np.int64)
            chunks = own.flatten().dictionary_encode()
            distinct = pc.binary_join_element_wise(pa.scalar(lead, pa.large_string()), chunks.dictionary.cast(pa.large_string()), pa.scalar("", pa.large_string()))
            flat, sizes = self.memo.ids(self.memo.entries(distinct.to_numpy(zero_copy_only=False).tolist())[np.asarray(chunks.indices)])
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
            for i, ids in zip(np.flatnonzero(np.asarray(rows)).tolist(), np.split(flat, ends[:-1]), strict=False):
                out[i] = ids
        return out

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, bool]]:
        """(ids, whether both libraries agree) of each text in turn."""
        return ((ids, agrees) for ids, agrees, _ in self.checked(pa.array(texts, pa.string())))

    def checked(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, bool, str]]:
        """(ids, whether the SentencePiece library gives the same for the whole text, the text that these ids decode to) of each text in turn."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        for a, b in slices(pc.binary_length(texts).to_pylist(), LOOKUP_BYTES):
            part = texts.slice(a, b - a)
            values = part.to_pylist()
            ids = self._by_segments(part) if self.simple else [np.array(x, np.uint32) for x in self._batch(values)]
            peers = self.peer.encode(values, num_threads=self.threads)
            agree = [len(x) == len(y) and bool((x == np.array(y, np.uint32)).all()) for x, y in zip(ids, peers, strict=True)]
            self.wrong += agree.count(False)
            back = self._text([y if same else x.tolist() for x, y, same in zip(ids, peers, agree, strict=True)])
            yield from zip(ids, agree, back, strict=True)

    def _text(self, lists: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(lists, skip_special_tokens=False)

    def decode(self, lists: list[np.ndarray]) -> list[str]:
        """Texts of lists of ids; control ids are silent."""
        for ids in lists:
            if len(ids) and (ids.min() < 0 or ids.max() >= len(self.silent)):
                raise ValueError("an id isn't in the model")
        unknown = self.model.kinds.index(UNKNOWN)
        if self.model.byte_fallback and any((ids == unknown).any() for ids in lists):
            return backend(self.model, whole=False, lossless=False).decode_batch([ids[~self.silent[ids]].tolist() for ids in lists], skip_special_tokens=False)
        return self._text([ids[~self.silent[ids]].tolist() for ids in lists])


_codecs: dict[tuple[str, int], Codec] = {}


def codec(path: str, threads: int = THREADS) -> Codec:
    """One codec for each Python worker and model file."""
    if (path, threads) not in _codecs:
        with open(path, "rb") as f:
            _codecs[path, threads] = Codec(f.read(), threads)
    return _codecs[path, threads]


def encode(text: Column, path: str, threads: int = THREADS) -> Column:
    """struct<ids, agrees> of each text."""

    def run(texts: pa.Array) -> pa.Array:
        found = list(codec(path, threads).encode(texts.to_pylist()))
        offsets = np.concatenate([[0], np.cumsum([len(i) for i, _ in found], dtype=np.int64)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint32), *(i for i, _ in found)]).astype(np.int32)))
        return pa.StructArray.from_arrays([ids, pa.array([a for _, a in found], pa.bool_())], names=["ids", "agrees"])

    return F.arrow_udf(by_parts(run), "struct<ids:array<int>,agrees:boolean>")(text.cast("string"))


def _rows(ids: pa.ListArray) -> list[np.ndarray]:
    flat, ends = np.asarray(ids.values), np.asarray(ids.offsets)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def decode(ids: Column, path: str) -> Column:
    """Text of each list of ids."""
    return F.arrow_udf(by_parts(lambda lists: pa.array(codec(path).decode(_rows(lists)), pa.string())), "string")(ids)


CHECKED = "struct<n_ids:long,ids_crc32:long,agrees:boolean,round_trip:boolean,text_crc32:long>"


def checked(text: Column, path: str, threads: int = THREADS) -> Column:
    """Each whole text encoded, compared with the other library, and decoded again from its ids, all in one Python step, see CHECKED.

    ids_crc32 is over unsigned little-endian 32-bit ids, text_crc32 over the UTF-8 of the decoded text; round_trip: that text is the given one.
    """

    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for given, (ids, agrees, back) in zip(texts.to_pylist(), codec(path, threads).checked(texts), strict=True):
            rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), agrees, back == (given or ""), zlib.crc32(back.encode())))
        names, types = zip(*(x.split(":") for x in CHECKED[7:-1].split(",")), strict=True)
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, pa.bool_() if t == "boolean" else pa.int64()) for c, t in zip(columns, types, strict=True)], names=list(names))

    return F.arrow_udf(by_parts(run, BATCH_ROWS), CHECKED)(text.cast("string"))


def piece_model() -> str:
    """Path of the public SentencePiece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
