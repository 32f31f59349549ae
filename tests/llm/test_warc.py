import hashlib
import random
from pathlib import Path

from docloom.llm import warc
from docloom.llm.common import new_folder

ROWS = [
    (5, "http://a/5", "x" * 120), (3, "http://a/3", "x" * 120), (9, None, "x" * 120), (3, "http://a/3", "x" * 120),
    (1, "http://b/\r\n1", "é\r\n\r\nWARC/1.1\r\n" * 20), (2, "u", "é\r\n\r\nWARC/1.1\r\n" * 20), (7, "u", "short"), (8, "u", "short"), (10, "u", None), (11, "u", ""), (12, "u", "long " * 200_000),
]


def test_round_trip_matches_brute_force(spark):
    pages = spark.createDataFrame([(*r, "extra") for r in ROWS], "page_id long, url string, html string, payload_digest string")
    path = new_folder(spark, "t")
    warc.write_archives(pages, path, per_archive=3)
    got = sorted(map(tuple, warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    want = []
    for page, _, html in ROWS:
        raw = (html or "").encode()
        first = min(p for p, _, h in ROWS if (h or "").encode() == raw) if len(raw) >= 100 else page
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "response" if first == page else "revisit", None if first == page else first))
    assert got == sorted(want, key=str)


def test_archives_are_bounded_by_bytes(spark):
    rows = [(i, "u", f"{i} " * 10) for i in range(1500)] + [(2000 + i, "u", f"{i:04}" * 500_000) for i in range(4)] + [(3000 + i, "u", "same" * 500_000) for i in range(40)] + [(4000 + i, "u", f"{i} " * 50_000) for i in range(100)]
    pages, path = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), new_folder(spark, "t")
    warc.write_archives(pages, path)
    files = [f.stat().st_size for f in Path(path.removeprefix("file:")).glob("part-*")]
    assert max(files) < 10 << 20 and len(files) < 60
    got = warc.read_archives(spark, path)
    assert got.count() == len(rows) and got.where("record_type = 'revisit'").count() == 39 and got.where("payload_bytes = 2000000").count() == 44


def test_empty_table(spark):
    path = new_folder(spark, "t")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).collect() == []


def test_records_are_plain_warc(spark):
    pages = spark.createDataFrame([(1, "http://x/", "<p>hi</p>")], "page_id long, url string, html string")
    (raw,) = [r[0] for r in warc.records(warc.resolve(pages)).collect()]
    ((fields, block),) = warc.parse_archive((raw + warc.END).encode())
    assert bytes(block) == b"<p>hi</p>" and fields["warc-type"] == "response" and fields["content-length"] == "9"


def test_page_ids_that_clash(spark):
    """Rows share a page_id with other payloads, and payloads with other page_ids, some of equal length."""
    rng = random.Random(3)
    payloads = ["a" * 200, "b" * 150, "c" * 150, "d" * 200, "é" * 120, "short"]
    rows = [(1, "a" * 200), (1, "b" * 150), (2, "a" * 200), (3, "b" * 150)] + [(rng.randrange(12), rng.choice(payloads)) for _ in range(80)]
    pages, path = spark.createDataFrame([(p, "u", h) for p, h in rows], "page_id long, url string, html string").repartition(4), new_folder(spark, "t")
    warc.write_archives(pages, path)
    want = []
    for page, html in rows:
        raw = html.encode()
        first = min(p for p, h in rows if h == html) if len(raw) >= 100 else page
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "response" if first == page else "revisit", None if first == page else first))
    assert sorted(map(tuple, warc.read_archives(spark, path).collect()), key=str) == sorted(want, key=str)
