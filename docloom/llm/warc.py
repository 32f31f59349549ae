"""WARC archives with duplicates written as revisit records.

Headers alone (page id, payload length, SHA-256) are grouped by digest; the page with the smallest id becomes the response
and the others revisit it. Spark's text writer lays down the records, so archives land on whatever file system holds the
shared folder; reading resolves each revisit by a join to its original's record id.

Defined cases: a null html is an empty payload; payloads under MIN_REVISIT_BYTES are always responses; a null url leaves
WARC-Target-URI out; rows that repeat a (page_id, html) pair which is the smallest of its group are all responses, and rows that share a
page_id with other payloads are pages each, with record ids of their own; a null page_id
never becomes an original unless the whole group has none, and is then a response; extra columns are ignored; no rows give no records.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

MIN_REVISIT_BYTES = 100
#: Payloads of up to so many bytes, and how many such records an archive holds. A task reads archives whole, so they stay near 8 MB; a longer page has one of its own.
ARCHIVES = ((1 << 13, 1000), (1 << 17, 64), (1 << 20, 8), (1 << 62, 1))
END = "\r\n\r\n"
WARC_DATE = "2024-01-01T00:00:00Z"


def payload_headers(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload.cast("binary"), 256).alias("payload_digest"))


def duplicate_originals(headers: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """payload_digest, original: the smallest page_id of each digest that more than one record has. Partial aggregation keeps a hot digest to a row a task."""
    return headers.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", "original")


def resolve(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Each page with record_type and refers_to.

    Only digests that repeat are joined back; as a written table their size is known, so the planner broadcasts them under its
    threshold and otherwise shuffles both sides, where a hot digest is split as a skewed join.
    """
    headers = payload_headers(pages)
    originals = materialize(duplicate_originals(headers, min_bytes), "warc-originals")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return headers.join(originals, "payload_digest", "left").select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("original")).alias("refers_to"))


def record_id(page_id: Column, digest: Column) -> Column:
    """From the page id and the payload digest, since rows with other payloads may share a page id."""
    h = F.sha2(F.concat(F.lit("page "), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(" "), digest).cast("binary"), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))


def records(resolved: DataFrame, date: str = WARC_DATE) -> DataFrame:
    """One column, the whole record without the two line ends that close it. A revisit has no block."""
    revisit = F.col("record_type") == "revisit"
    optional = lambda c: F.coalesce(c, F.lit(""))
    return resolved.select(
        F.concat(
            F.lit("WARC/1.1\r\n"), _field("WARC-Type", F.col("record_type")), _field("WARC-Record-ID", record_id(F.col("page_id"), F.col("payload_digest"))), F.lit(f"WARC-Date: {date}\r\n"),
            optional(_field("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", ""))), optional(_field("X-Page-Id", F.col("page_id"))), _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
            F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), _field("WARC-Refers-To", record_id(F.col("refers_to"), F.col("payload_digest"))))).otherwise(F.lit("Content-Type: text/html; charset=utf-8\r\n")),
            _field("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))), F.lit("\r\n"), F.when(revisit, F.lit("")).otherwise(F.col("payload")),
        ).alias("value")
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, per_archive: int = 1000, archives: tuple[tuple[int, int], ...] = ARCHIVES, date: str = WARC_DATE) -> None:
    """One write for each size of payloads that occurs, without a shuffle of payloads; revisits, which have none, go with the shortest."""
    size = F.octet_length(F.coalesce("html", F.lit("")))
    sizes = [(low, most, min(count, per_archive)) for low, (most, count) in zip([-1, *(most for most, _ in archives[:-1])], archives, strict=True)]
    found = pages.agg(*[F.bool_or((size > low) & (size <= most)).alias(f"has_{low}") for low, most, _ in sizes]).first()
    resolved, payload, revisit = resolve(pages, min_bytes), F.col("payload_bytes"), F.col("record_type") == "revisit"
    for i, (low, most, count) in enumerate(sizes):
        own = (payload <= most) | revisit if i == 0 else (payload > low) & (payload <= most) & ~revisit
        if found[i] or i == 0:
            records(resolved.where(own), date).write.mode("append").option("lineSep", END).option("maxRecordsPerFile", count).text(path)


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """(header fields by lower-cased name, block) of each record, by Content-Length."""
    at, view = 0, memoryview(content)
    while at < len(content):
        stop = content.index(b"\r\n\r\n", at)
        lines = content[at:stop].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        yield fields, view[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + len(END)


READ_SCHEMA = "record_id string, page_id long, record_type string, refers_to_id string, block_bytes long, block_digest string, stated_digest string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for f, block in parse_archive(content.as_py()):
                page = f.get("x-page-id")
                rows.append((f["warc-record-id"], None if page is None else int(page), f["warc-type"], f.get("warc-refers-to"), len(block), hashlib.sha256(block).hexdigest(), f["warc-payload-digest"].removeprefix("sha256:")))
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * len(types), types, strict=True)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; a revisit takes its length from its original.

    The digest of a response is that of the bytes read; one that differs from its header raises.
    """
    found = materialize(spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, READ_SCHEMA), "warc-headers")
    wrong = F.raise_error(F.concat(F.lit("payload digest of "), F.col("record_id"), F.lit(" differs from its header")))
    responses = found.where("record_type = 'response'").select("record_id", "page_id", "block_bytes", F.when(F.col("block_digest") == F.col("stated_digest"), F.col("block_digest")).otherwise(wrong).alias("digest"))
    originals = responses.groupBy("record_id").agg(F.min("page_id").alias("refers_to"), F.min("block_bytes").alias("payload_bytes"), F.min("digest").alias("payload_digest"))
    revisits = found.where("record_type = 'revisit'").select("page_id", "refers_to_id").join(originals, F.col("refers_to_id") == F.col("record_id"), "left")
    return responses.select("page_id", F.col("block_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    )
