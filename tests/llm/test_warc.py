import gzip
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo

from voltsheaf.llm import warc


def brute(rows, least=1000):
    best, count = {}, {}
    for i, h in rows:
        best[h or ""] = max(best.get(h or "", -1), i)
        count[h or ""] = count.get(h or "", 0) + 1
    out = []
    for i, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= least and count[h or ""] > 1 and best[h or ""] != i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", best[h or ""] if again else None))
    return sorted(out)


def test_round_trip(spark, sf_small):
    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    rows = [(r.page_id, r.html) for r in pages.collect()]
    extra = [(1000, "é" * 600), (1001, "é" * 600), (1002, None), (1003, "x" * 999), (1004, "x" * 999), (1005, "\r\n\r\n" * 400), (1006, "\r\n\r\n" * 400)]
    both = pages.select("page_id", "url", "html").union(spark.createDataFrame([(i, "u\r\nx: y", h) for i, h in extra], "page_id long, url string, html string"))
    got = sorted(tuple(r) for r in warc.archive_round_trip(both).collect())
    assert got == brute(rows + extra)
    assert warc.archive_round_trip(pages.limit(0)).collect() == []
    nulls = spark.createDataFrame([(None, None, None), (None, "u", "z" * 2000)], "page_id long, url string, html string")
    assert sorted(r.payload_bytes for r in warc.archive_round_trip(nulls).collect()) == [0, 2000]


def test_pushdown_and_skipping(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.example/{i}", "q" * 1500 if i % 2 else f"page {i}") for i in range(20)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.archive_round_trip(pages, path).count()
    back = spark.read.format("warc").load(path)
    some = back.filter("record_type = 'revisit' and target_uri like 'http://h1%'")
    assert {r.record_id for r in some.collect()} == {f"urn:page:{i}" for i in range(1, 19, 2) if i % 3 == 1}
    bare = spark.read.format("warc").option("payload", "false").load(path)
    assert bare.filter("payload is not null").count() == 0 and bare.filter("record_type <> 'warcinfo'").count() == 20
    # headers decide before payloads are inflated: a broken payload hurts only who wants it
    name = next(tmp_path.glob("w/part-*.warc.gz"))
    reader = warc.WarcReader({"path": f"file://{name}"})
    assert list(reader.pushFilters([EqualTo(("record_type",), "response"), EqualTo(("payload_length",), 3)])) == [EqualTo(("payload_length",), 3)]
    assert {r["record_type"] for b in reader.read(reader.partitions()[0]) for r in b.to_pylist()} == {"response"}


def test_unwanted_payloads_are_not_inflated(tmp_path):
    row = {"record_type": "response", "record_id": "urn:1", "target_uri": "u", "date": "d", "refers_to": None, "payload_digest": "x", "payload": bytes(np.random.default_rng(1).integers(0, 256, 100_000, np.uint8))}
    good = warc.gzip_member(warc.record_bytes(row | {"record_type": "revisit", "refers_to": "urn:1"}), 4)
    broken = bytearray(warc.gzip_member(warc.record_bytes(row), 4))
    broken[50_000:50_100] = b"\xff" * 100
    (tmp_path / "a.warc.gz").write_bytes(bytes(broken) + good)
    reader = warc.WarcReader({"path": f"file://{tmp_path}/a.warc.gz"})
    with pytest.raises(zlib.error):
        list(reader.read(reader.partitions()[0]))
    reader.tests = [("record_type", "is", "revisit")]
    assert [r["record_type"] for b in reader.read(reader.partitions()[0]) for r in b.to_pylist()] == ["revisit"]


def test_append_and_overwrite(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.register(spark)

    def write(ids, mode):
        pages = spark.createDataFrame([(i, "u", f"page {i}") for i in ids], "page_id long, url string, html string")
        warc.page_records(pages).write.format("warc").mode(mode).save(path)

    def there():
        return sorted(r.record_id for r in spark.read.format("warc").load(path).filter("record_type = 'response'").collect())

    write(range(3), "append")
    write(range(3, 6), "append")
    assert there() == [f"urn:page:{i}" for i in range(6)]
    (tmp_path / "w" / f"part-{'0' * 32}.warc.gz").write_bytes(b"left by a failed task")
    (tmp_path / "w" / "theirs.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:9>\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    assert there() == [f"urn:page:{i}" for i in (0, 1, 2, 3, 4, 5, 9)]
    write([7], "overwrite")
    assert there() == ["urn:page:7"] and len(list((tmp_path / "w").glob("_manifest-*"))) == 1


def test_odd_pages(spark):
    rows = [(5, "u", "a" * 1000, "x"), (5, "v", "a" * 1000, "y"), (4, "w", "a" * 1000, "z"), (3, None, "b" * 6_000_000, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages).collect())
    assert got == [(3, 6_000_000, "response", None), (4, 1000, "revisit", 5), (5, 1000, "response", None), (5, 1000, "response", None)]


def test_foreign_archives(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:a>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record * 3)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record) * 2)
    warc.register(spark)
    rows = spark.read.format("warc").load(f"file://{tmp_path}").collect()
    assert len(rows) == 5 and all(bytes(r.payload) == b"hello" and r.record_id == "urn:a" for r in rows)


def test_many_records_in_a_gzip_member(spark, tmp_path):
    records = [f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:{i}>\r\nContent-Length: {4 * n}\r\n\r\n".encode() + b"\r\n\r\n" * n + b"\r\n\r\n" for i, n in enumerate((0, 5, 900_000, 3, 1))]
    whole = b"".join(records)
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(whole))
    (tmp_path / "pairs.warc.gz").write_bytes(gzip.compress(b"".join(records[:2])) + gzip.compress(b"".join(records[2:])) + bytes(512))
    (tmp_path / "cut.warc.gz").write_bytes(b"".join(gzip.compress(whole[k : k + 60_000]) for k in range(0, len(whole), 60_000)))
    warc.register(spark)
    want = [("urn:0", 0), ("urn:1", 20), ("urn:2", 3_600_000), ("urn:3", 12), ("urn:4", 4)]
    for name in ("whole", "pairs", "cut"):
        back = spark.read.format("warc").load(f"file://{tmp_path}/{name}.warc.gz")
        assert sorted((r.record_id, len(r.payload)) for r in back.collect()) == want
        assert [r.record_id for r in back.filter("record_id = 'urn:3'").collect()] == ["urn:3"]
