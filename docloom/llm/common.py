"""Shared helpers: the shared work folder, materialised tables, text slices."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Workers live on through many stages; the system's allocator gives large buffers back when they are freed.
pa.set_memory_pool(pa.system_memory_pool())

#: A document is held out of learning if crc32 of its id (as text) leaves this remainder.
FOLDS, HELD_OUT = 4, 2
#: Rows of an Arrow batch that a function handles at once.
PART_ROWS = 256


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a purely local session, as in tests, gets a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, and gives the planner true sizes."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hand_back() -> None:
    """At the end of a task: give freed memory back to the system, where its C library can; the worker lives on through other stages."""
    gc.collect()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read again."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def held_out_sql(id_column: str = "doc_id") -> str:
    return f"crc32(cast(cast({id_column} as string) as binary)) % {FOLDS} = {HELD_OUT}"


def encoded(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in texts.cast(pa.large_binary()).to_pylist()]


def by_parts(run, rows: int = PART_ROWS):
    """An Arrow function that runs over a few hundred rows at a time, so that what it holds beside a batch stays small."""

    def over(values: pa.Array) -> pa.Array:
        if len(values) <= rows:
            return run(values)
        return pa.concat_arrays([run(values.slice(i, rows)) for i in range(0, len(values), rows)])

    return over


def slices(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Consecutive ranges whose sizes sum to at most `most`; one larger item stands alone."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            out.append((start, i))
            start, total = i, 0
        total += n
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out


def mix64(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) over uint64."""
    x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
