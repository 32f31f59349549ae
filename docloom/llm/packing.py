"""Packing token sequences by minimum bin slack.

A document is its token ids and a closing id. Whole windows of the capacity are cut off its front; the rest, shorter than the
capacity, joins the lengths that wait in the task. Bins are filled one at a time: the longest waiting length goes in, then a
subset-sum over the multiset of waiting lengths, held as a bitset in one integer (bit s: some choice sums to s), picks the
choice that leaves least slack; walking back over the bitsets gives how many of each length it takes. Documents are packed where
they are read, WAITING at a time, without a shuffle; what is left at the end of a task and can't fill a bin is cut into sequences
whose sizes are powers of two, which need no padding.

Token ids come from a word-level memo over a tokenizers file: the file's pre-tokenizer never joins across a space or a line end,
so encoding the distinct chunks between those and laying their ids end to end equals encoding the whole text. Arrow cuts texts into
chunks and finds the distinct ones of a few megabytes of text; only those are looked up in Python.

Defined cases: null and empty texts hold only the closing id; repeated rows are packed each on its own; a null doc_id is kept;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hand_back, slices

CAPACITY, END_ID = 4096, 2
#: Remainders that a task packs together.
WAITING = 20_000
#: Distinct chunks that a Python worker remembers (about 250 bytes each), and bytes of text that it looks up at once.
MEMO_WORDS, MEMO_CHARS = 300_000, 1 << 20
#: A special token of the file.
SEPARATOR = "<|endoftext|>"
#: Marks that a chunk of letters may end with, and how such a chunk ends.
MARKS, CLOSED = ".,", "[A-Za-z\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{FF}][.,]$"
# How the file marks a word's last token, how it normalises and cuts texts, and its pre-tokenizer's words in chunks of letters, digits and marks without an apostrophe.
WORD_END = "</w>"
_LETTERS, _SIGNS = "A-Za-z\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{FF}", "!-&(-/:-@\\[-`{-~"
PLAIN, PLAIN_WORD = f"^[{_LETTERS}0-9{_SIGNS}]+$", f"[{_LETTERS}]+|[0-9]|[{_SIGNS}]+"
NORMALISES = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUTS = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Chunks in one text of a batch.
TOGETHER = 256
#: Rows of a batch that are looked up together.
PART_ROWS = 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordMemo:
    """Ids of texts by way of their distinct chunks. Once it holds over `most` chunks, it keeps the half that was used last.

    encode: a list of distinct chunks to their ids end to end and the number of ids of each.
    """

    def __init__(self, encode, most: int = MEMO_WORDS):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.turn = self.used = 0
        self.at: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts, self.sizes, self.last = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def forget(self) -> None:
        n, chunks = len(self.at), list(self.at)
        kept = np.sort(np.argsort(-self.last[:n], kind="stable")[: self.most // 2])
        sizes = self.sizes[kept]
        ends = np.cumsum(sizes, dtype=np.int64)
        flat = self.flat[np.repeat(self.starts[kept] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        self.used = len(flat)
        self.flat[: self.used] = flat
        self.starts[: len(kept)], self.sizes[: len(kept)], self.last[: len(kept)] = ends - sizes, sizes, self.last[kept]
        self.at = {chunks[i]: j for j, i in enumerate(kept.tolist())}

    def learn(self, chunks: list[str]) -> None:
        flat, sizes = self.encode(chunks)
        n, total = len(self.at), len(flat)
        while n + len(chunks) > len(self.starts):
            self.starts, self.sizes, self.last = (np.concatenate([x, x]) for x in (self.starts, self.sizes, self.last))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.sizes[n : n + len(chunks)] = sizes
        self.starts[n : n + len(chunks)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + total] = flat
        self.used += total
        self.at.update(zip(chunks, range(n, n + len(chunks)), strict=True))

    def entries(self, chunks: list[str]) -> np.ndarray:
        """The entry of each distinct chunk, good until the next call."""
        if len(self.at) > self.most:
            self.forget()
        k = list(map(self.at.get, chunks))
        if None in k:
            self.learn([c for c, i in zip(chunks, k, strict=True) if i is None])
            k = list(map(self.at.__getitem__, chunks))
        k = np.array(k, np.int64)
        self.turn += 1
        self.last[k] = self.turn
        return k

    def ids(self, entries: np.ndarray, tails: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The entries' ids end to end, and the number of ids of each. tails: a further id after each entry, or -1 for none."""
        own = self.sizes[entries].astype(np.int64)
        sizes = own if tails is None else own + (tails >= 0)
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[entries] - (ends - sizes), sizes)
        at += np.arange(len(at))
        flat = self.flat[np.minimum(at, len(self.flat) - 1, out=at)]
        if tails is not None:
            tailed = np.flatnonzero(tails >= 0)
            flat[ends[tailed] - 1] = tails[tailed]
        return flat, sizes


def plainer(chunks: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Chunks with the same ids but fewer distinct ones, and which mark of MARKS was cut off each (-1: none): Latin-1 chunks in lower case,
    as the file's normaliser puts them, and a full stop or comma that closes a word of letters set off, as its pre-tokenizer splits them."""
    plain = pc.and_(pc.match_substring_regex(chunks, r"^[\x00-\x{FF}]*$"), pc.invert(pc.match_substring(chunks, "<|")))
    lower = pc.if_else(plain, pc.utf8_lower(chunks), chunks)
    cut = pc.and_(plain, pc.match_substring_regex(lower, CLOSED))
    mark = pc.if_else(pc.ends_with(lower, MARKS[1]), 1, 0)
    return pc.if_else(cut, pc.utf8_slice_codeunits(lower, 0, -1), lower), np.asarray(pc.if_else(cut, mark, -1)).astype(np.int64)


def texts_ids(memo: WordMemo, texts: pa.Array | list[str | None], most: int = MEMO_CHARS) -> Iterator[np.ndarray]:
    """The ids of each text in turn, looked up for about `most` bytes at a time; only distinct chunks leave Arrow."""
    texts = pc.fill_null((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string()), "")
    marks, _ = memo.encode(list(MARKS))
    for a, b in slices(pc.binary_length(texts).to_pylist(), most):
        own = pc.split_pattern(pc.replace_substring(texts.slice(a, b - a), "\n", " "), " ")
        chunks = own.flatten().dictionary_encode()
        words, cut = plainer(chunks.dictionary)
        words = words.dictionary_encode()
        entries = memo.entries(words.dictionary.to_numpy(zero_copy_only=False).tolist())[np.asarray(words.indices)]
        at = np.asarray(chunks.indices)
        flat, sizes = memo.ids(entries[at], np.append(marks.astype(np.int64), -1)[cut][at])
        ends = np.cumsum(sizes)[np.cumsum(np.asarray(pc.list_value_length(own))) - 1]
        yield from np.split(flat, ends[:-1])


def separated(tokenizer, separator: str):
    """encode for WordMemo: the distinct chunks that the file's pre-tokenizer cuts in a way known beforehand are encoded with spaces between,
    where the marked last token of each word shows the ends; others with a special token between, whose id shows them."""
    mark = tokenizer.token_to_id(separator)
    closes = np.zeros(tokenizer.get_vocab_size(), bool)
    closes[[i for t, i in tokenizer.get_vocab().items() if t.endswith(WORD_END)]] = True

    def run(chunks: list[str], between: str) -> np.ndarray:
        texts = [between.join(chunks[i : i + TOGETHER]) for i in range(0, len(chunks), TOGETHER)]
        return np.concatenate([np.zeros(0, np.uint32), *(np.array([*e.ids, mark], np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False))])

    def by_words(chunks: list[str], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = run(chunks, " ")
        flat = flat[flat != mark]
        ends = np.flatnonzero(closes[flat])[np.cumsum(words) - 1]
        return flat, np.diff(ends, prepend=-1)

    def by_marks(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat = run(chunks, separator)
        sizes = np.diff(np.flatnonzero(flat == mark), prepend=-1) - 1
        return flat[flat != mark], sizes

    def alone(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [tokenizer.encode(c, add_special_tokens=False).ids for c in chunks]
        return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)

    def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        column = pa.array(chunks, pa.large_string())
        odd = np.asarray(pc.match_substring(column, "<|"))
        plain = np.asarray(pc.match_substring_regex(column, PLAIN)) & ~odd
        words = np.asarray(pc.count_substring_regex(column, PLAIN_WORD)).astype(np.int64)
        kinds = [np.flatnonzero(plain), np.flatnonzero(~plain & ~odd), np.flatnonzero(odd)]
        pick = lambda rows: [chunks[i] for i in rows.tolist()]
        parts = [by_words(pick(kinds[0]), words[kinds[0]]), by_marks(pick(kinds[1])), alone(pick(kinds[2]))]
        sizes = np.zeros(len(chunks), np.int64)
        for rows, (_, own) in zip(kinds, parts, strict=True):
            sizes[rows] = own
        flat, starts = np.zeros(int(sizes.sum()), np.uint32), np.cumsum(sizes) - sizes
        for rows, (ids, own) in zip(kinds, parts, strict=True):
            flat[np.repeat(starts[rows] - (np.cumsum(own) - own), own) + np.arange(len(ids))] = ids
        return flat, sizes

    return encode


def cut_as_known(path: str):
    """The tokenizer of a file, if it puts texts in lower case and cuts them as PLAIN_WORD, `plainer` and the cut at spaces take for granted; another file raises."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    says = json.loads(tokenizer.to_str())
    if (says["normalizer"], says["pre_tokenizer"], says["model"].get("end_of_word_suffix")) != (NORMALISES, CUTS, WORD_END):
        raise ValueError(f"{path} normalises or cuts texts in another way than this packing knows")
    return tokenizer


def memo_for(path: str, most: int = MEMO_WORDS) -> WordMemo:
    return WordMemo(separated(cut_as_known(path), SEPARATOR), most)


def fullest(sizes: list[int], count, room: int) -> dict[int, int]:
    """How many of each length (sizes ascending, count(size) of each at hand) sum closest to room without passing it.

    Counts go in by binary lots, so that a length held n times takes log n steps; longest first, and no further once room is reached.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for i in range(bisect.bisect_right(sizes, room) - 1, -1, -1):
        size = sizes[i]
        left, lot = min(count(size), room // size), 1
        while left > 0:
            take = min(lot, left)
            steps.append((size, take, reach))
            reach |= (reach << (size * take)) & mask
            left, lot = left - take, lot * 2
        if reach >> room:
            break
    total, chosen = reach.bit_length() - 1, {}
    for size, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[size] = chosen.get(size, 0) + take
            total -= size * take
    return chosen


class Bins:
    """Waiting remainders by length and the bins they go to."""

    def __init__(self, capacity: int):
        self.capacity, self.by_size, self.sizes, self.n = capacity, {}, [], 0

    def add(self, size: int, item) -> None:
        if size not in self.by_size:
            self.by_size[size] = []
            bisect.insort(self.sizes, size)
        self.by_size[size].append(item)
        self.n += 1

    def take(self, size: int):
        lot = self.by_size[size]
        item = lot.pop()
        if not lot:
            del self.by_size[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))
        self.n -= 1
        return size, item

    def next(self) -> list[tuple[int, object]]:
        """The pieces of the next bin, with their lengths: the longest that waits, and what fills the rest best."""
        longest = self.sizes[-1]
        out = [self.take(longest)]
        for size, n in fullest(self.sizes, lambda s: len(self.by_size[s]), self.capacity - longest).items():
            out += [self.take(size) for _ in range(n)]
        return out


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _packer(path: str, capacity: int, end_id: int, waiting: int, memo_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 32
        memo, bins, rows = memo_for(path, memo_words), Bins(capacity), []

        def place(pieces: list[tuple]) -> None:
            """pieces: doc_id, start, ids, doc_tokens; one sequence."""
            nonlocal sequence
            offset = 0
            for doc, start, ids, tokens in pieces:
                rows.append((doc, start, len(ids), _crc(ids), tokens, sequence, offset))
                offset += len(ids)
            sequence += 1

        def flush(last: bool) -> None:
            """Fill bins until too few remainders wait to choose from; at the end, cut what has slack by powers of two."""
            slack = []
            while bins.n and (last or bins.n > waiting // 2):
                got = bins.next()
                if sum(s for s, _ in got) < capacity:
                    slack += [x for _, x in got]
                else:
                    place([x for _, x in got])
            left = sum(len(x[2]) for x in slack)
            while left:
                room = min(capacity, 1 << (left.bit_length() - 1))
                left -= room
                own = []
                while room:
                    doc, start, ids, tokens = slack.pop()
                    own.append((doc, start, ids[:room], tokens))
                    if len(ids) > room:
                        slack.append((doc, start + room, ids[room:], tokens))
                    room -= len(own[-1][2])
                place(own)

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 7
            rows.clear()
            return pa.record_batch([pa.array(x, pa.int64()) for x in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in (b.slice(i, PART_ROWS) for b in batches for i in range(0, b.num_rows, PART_ROWS)):
            for doc, found in zip(batch.column(0).to_pylist(), texts_ids(memo, batch.column(1)), strict=True):
                ids = np.append(found, np.uint32(end_id))
                n = len(ids)
                cut = n - n % capacity
                for start in range(0, cut, capacity):
                    place([(doc, start, ids[start : start + capacity], n)])
                if n > cut:
                    bins.add(n - cut, (doc, cut, ids[cut:].copy(), n))
                if bins.n >= waiting:
                    flush(False)
                if len(rows) >= 50_000:
                    yield out()
        flush(True)
        yield out()
        del memo
        hand_back()

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, waiting: int = WAITING, memo_words: int = MEMO_WORDS) -> DataFrame:
    """One row for each piece of each document, see SCHEMA. sequence_id is unique over the whole result."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_packer(tokenizer_path, capacity, end_id, waiting, memo_words), SCHEMA)


def word_tokenizer() -> str:
    """Path of the public word-level BPE file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
