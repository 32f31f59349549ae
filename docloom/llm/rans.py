"""Token ids in entropy-coded files: a static range asymmetric numeral system.

Documents are dealt by ranges of doc_id, so that files follow each other in ascending order, and tokenized where they are encoded. A task writes groups
of whole documents; a group counts its own ids into one frequency table, which its blocks share. A block of at most BLOCK_IDS ids is coded by
itself on interleaved lanes: id i belongs to lane i mod lanes, all lanes step together and share one stream of 32-bit words. Each
EVERY steps the block keeps a checkpoint, the lanes' states and the place in the stream, and the crc32 of the ids from there to the next, so
that any stretch can be decoded, and checked, without those before. A group is a row of a Parquet table, which brings Spark's commit of files, splits
for parallel readers, and columns (lengths, doc_ids) that are read without the ids.

Block: MAGIC, version, lanes, EVERY, number of ids, words and checkpoints; then crc32s, places, states, words; then the crc32 of all that, little-endian.

Defined cases: a null or empty text is the closing id alone; a null doc_id is kept and sorts first; rows that share a doc_id follow each other by
xxhash64 of their text, equal rows by their place in the input; a long document makes a long group; extra columns are ignored; no rows give
no groups. A damaged block raises.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hand_back
from .packing import PART_ROWS, WordMemo, memo_for, texts_ids

END_ID = 1
#: Frequencies of a table sum to 1 << SCALE_BITS; a lane's state is kept in [LOW, LOW << 32).
SCALE_BITS, LOW = 20, 1 << 31
LANES, IDS_A_LANE = 1024, 256
#: Steps between checkpoints, ids in a block, and ids and documents after which a group is closed.
EVERY, BLOCK_IDS, GROUP_IDS, GROUP_DOCS = 512, 1 << 20, 1 << 22, 1 << 15
MAGIC, VERSION, HEAD = b"LOOM", 1, struct.Struct("<4sHIIQQI")
GROUP = "shard int, part int, n_ids long, doc_ids array<long>, lengths array<long>, frequencies binary, blocks array<binary>"
ROW_GROUP = 16 << 20
#: Distinct chunks that a worker remembers from task to task (about 250 bytes each), and bytes of text that it looks up at once.
MEMO_WORDS, MEMO_CHARS = 600_000, 4 << 20


class Frequencies(NamedTuple):
    """ids: those that occur, ascending; freq: shares of 1 << SCALE_BITS, each at least 1; before: sums of those before."""

    ids: np.ndarray
    freq: np.ndarray
    before: np.ndarray


def frequencies(counts: np.ndarray) -> Frequencies:
    """From the count of each id."""
    ids = np.flatnonzero(counts)
    if len(ids) > 1 << SCALE_BITS:
        raise ValueError(f"{len(ids)} distinct ids don't fit a table of {1 << SCALE_BITS}")
    total, room = int(counts.sum()), (1 << SCALE_BITS) - len(ids)
    freq = np.array([1 + c * room // total for c in counts[ids].tolist()], np.uint64)
    if len(ids):
        freq[np.argmax(freq)] += np.uint64((1 << SCALE_BITS) - int(freq.sum()))
    return _table(ids, freq)


def _table(ids: np.ndarray, freq: np.ndarray) -> Frequencies:
    return Frequencies(ids.astype(np.uint32), freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64))


def packed(t: Frequencies) -> bytes:
    return zlib.compress(np.diff(t.ids, prepend=np.uint32(0)).astype("<u4").tobytes() + t.freq.astype("<u4").tobytes())


def unpacked(data: bytes) -> Frequencies:
    both = np.frombuffer(zlib.decompress(data), "<u4")
    return _table(np.cumsum(both[: len(both) // 2], dtype=np.uint64), both[len(both) // 2 :])


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encoded(ids: np.ndarray, t: Frequencies, every: int = EVERY) -> bytes:
    """One block; ids all occur in t."""
    n, bits = len(ids), np.uint64(SCALE_BITS)
    lanes = min(LANES, max(1, n // IDS_A_LANE))
    place = np.zeros(int(t.ids[-1]) + 1 if len(t.ids) else 0, np.uint32)
    place[t.ids] = np.arange(len(t.ids))
    at = place[ids]
    freq, before = t.freq[at], t.before[at]
    state, words, emitted, marks = np.full(lanes, LOW, np.uint64), [], 0, []
    for step in range(-(-n // lanes) - 1, -1, -1):
        f, b = freq[step * lanes : (step + 1) * lanes], before[step * lanes : (step + 1) * lanes]
        x = state[: len(f)]
        full = x >= f << np.uint64(63 - SCALE_BITS)
        out = x[full]
        words.append(out.astype(np.uint32))
        emitted += len(out)
        x[full] = out >> np.uint64(32)
        q = x // f
        state[: len(f)] = (q << bits) + (x - q * f) + b
        if step % every == 0:
            marks.append((emitted, state.copy()))
    marks.reverse()
    cuts = range(0, n, lanes * every)
    body = b"".join((
        HEAD.pack(MAGIC, VERSION, lanes, every, n, emitted, len(marks)), np.array([crc(ids[i : i + lanes * every]) for i in cuts], "<u4").tobytes(),
        np.array([emitted - e for e, _ in marks], "<u8").tobytes(), *(s.astype("<u8").tobytes() for _, s in marks), *(w.astype("<u4").tobytes() for w in reversed(words)),
    ))
    return body + struct.pack("<I", zlib.crc32(body))


class Block:
    """A block's parts; decoded() gives the ids from any checkpoint to the next."""

    def __init__(self, data: bytes):
        if len(data) < HEAD.size + 4 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block is damaged: its checksum differs")
        magic, version, self.lanes, self.every, self.n, n_words, marks = HEAD.unpack_from(data)
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError(f"not a block of version {VERSION}")
        at = HEAD.size
        self.sums = np.frombuffer(data, "<u4", marks, at)
        self.places = np.frombuffer(data, "<u8", marks, at + 4 * marks)
        self.states = np.frombuffer(data, "<u8", marks * self.lanes, at + 12 * marks).reshape(marks, self.lanes)
        self.words = np.frombuffer(data, "<u4", n_words, at + 12 * marks + 8 * marks * self.lanes)

    def decoded(self, mark: int, t: Frequencies, slots: np.ndarray) -> np.ndarray:
        start = mark * self.every * self.lanes
        n, place = min(self.every * self.lanes, self.n - start), int(self.places[mark])
        state, low, mask, bits = self.states[mark].astype(np.uint64), np.uint64(LOW), np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
        found = np.empty(n, np.uint32)
        for i in range(0, n, self.lanes):
            x = state[: min(self.lanes, n - i)]
            slot = x & mask
            at = slots[slot]
            found[i : i + len(x)] = at
            x = t.freq[at] * (x >> bits) + slot - t.before[at]
            short = np.flatnonzero(x < low)
            x[short] = x[short] << np.uint64(32) | self.words[place : place + len(short)]
            place += len(short)
            state[: len(x)] = x
        ids = t.ids[found]
        if crc(ids) != self.sums[mark]:
            raise ValueError(f"ids after checkpoint {mark} differ from their checksum")
        return ids

    def ids(self, t: Frequencies, slots: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *(self.decoded(k, t, slots) for k in range(len(self.sums)))])


def slots_of(t: Frequencies) -> np.ndarray:
    """The place in t.ids of each of the 1 << SCALE_BITS slots."""
    return np.repeat(np.arange(len(t.ids), dtype=np.uint32), t.freq.astype(np.int64))


def _group(shard: int, part: int, docs: list[int | None], texts: list[np.ndarray], block_ids: int) -> pa.RecordBatch:
    ids = np.concatenate(texts)
    t = frequencies(np.bincount(ids))
    blocks = [encoded(ids[i : i + block_ids], t) for i in range(0, len(ids), block_ids)]
    row = [[shard], [part], [len(ids)], [docs], [list(map(len, texts))], [packed(t)], [blocks]]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary())]
    return pa.record_batch([pa.array(x, k) for x, k in zip(row, types, strict=True)], names=[x.split()[0] for x in GROUP.split(", ")])


@functools.lru_cache(1)
def _memo(path: str) -> WordMemo:
    return memo_for(path, MEMO_WORDS)


def _writer(tokenizer_path: str, end_id: int, group_ids: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, part, memo, docs, texts, n = TaskContext.get().partitionId(), 0, _memo(tokenizer_path), [], [], 0
        for batch in (b.slice(i, PART_ROWS) for b in batches for i in range(0, b.num_rows, PART_ROWS)):
            for doc, found in zip(batch.column(0).to_pylist(), texts_ids(memo, batch.column(1), MEMO_CHARS), strict=True):
                docs.append(doc)
                texts.append(np.append(found, np.uint32(end_id)))
                n += len(texts[-1])
                if n >= group_ids or len(docs) >= GROUP_DOCS:
                    yield _group(shard, part, docs, texts, block_ids)
                    part, docs, texts, n = part + 1, [], [], 0
        if docs:
            yield _group(shard, part, docs, texts, block_ids)
        hand_back()

    return run


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, group_ids: int = GROUP_IDS, block_ids: int = BLOCK_IDS) -> None:
    """The ids of all documents, in ascending doc_id, as files under path."""
    by = ["doc_id", "_text", "_row"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumns({"_text": F.xxhash64("text"), "_row": F.monotonically_increasing_id()}).repartitionByRange(*by).sortWithinPartitions(*by)
    rows.select("doc_id", "text").mapInArrow(_writer(tokenizer_path, end_id, group_ids, block_ids), GROUP).write.option("parquet.block.size", ROW_GROUP).option("compression", "none").parquet(path)


def group_ids_of(frequency_table: bytes, blocks: list[bytes]) -> np.ndarray:
    t = unpacked(frequency_table)
    slots = slots_of(t)
    return np.concatenate([np.zeros(0, np.uint32), *(Block(b).ids(t, slots) for b in blocks)])


def _reader(whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i] for k in batch.schema.names}
                lengths = np.array(row["lengths"].as_py(), np.int64)
                ids, ends = group_ids_of(row["frequencies"].as_py(), row["blocks"].as_py()), np.cumsum(lengths)
                if len(ids) != row["n_ids"].as_py() or len(ids) != lengths.sum():
                    raise ValueError(f"shard {row['shard']}, group {row['part']}: {len(ids)} ids")
                texts = np.split(ids, ends[:-1])
                same = lambda x, n=len(lengths): pa.array(np.full(n, x.as_py(), np.int32))
                last = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32))) if whole else pa.array([crc(x) for x in texts], pa.int64())
                yield pa.record_batch([same(row["shard"]), same(row["part"]), row["doc_ids"].values, pa.array(ends - lengths), pa.array(lengths), last], names=["shard", "part", "doc_id", "own_start", "n_tokens", "found"])

    return run


def starts(groups: DataFrame) -> DataFrame:
    """shard, part, before: ids in all groups before. A group is some millions of ids, so these are few rows; those of a shard are numbered by themselves."""
    earlier = lambda *by: Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = groups.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("shards_before", F.coalesce(F.sum("n").over(earlier()), F.lit(0))).drop("n")
    return groups.withColumn("own", F.coalesce(F.sum("n_ids").over(earlier("shard")), F.lit(0))).join(shards, "shard").select("shard", "part", (F.col("own") + F.col("shards_before")).alias("before"))


def read(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, or with `ids` the ids themselves, of every document; all blocks are decoded and checked."""
    table = spark.read.schema(GROUP).parquet(path)
    kind = "array<int>" if ids else "long"
    found = table.mapInArrow(_reader(ids), f"shard int, part int, doc_id long, own_start long, n_tokens long, found {kind}")
    joined = found.join(starts(table.select("shard", "part", "n_ids")), ["shard", "part"])
    return joined.select("doc_id", (F.col("before") + F.col("own_start")).alias("start"), "n_tokens", F.col("found").alias("ids" if ids else "ids_crc32"))
