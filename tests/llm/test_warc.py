import base64
import gzip
import hashlib


from reviewmill.llm import warc
from tests.llm.conftest import EXTRA, SF
from pyspark.sql import functions as F


def plain(pages):
    least = {}
    for i, html in pages:
        if i is not None:
            least[html or ""] = min(i, least.get(html or "", i))
    out = []
    for i, html in pages:
        body, first = (html or "").encode(), least.get(html or "")
        later = i is not None and i > first
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if later else "response", first if later else None))
    return out


def rows_of(frame):
    return [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in frame.collect()]


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert sorted(rows_of(warc.op4_warc(spark, SF))) == sorted(plain([(r.page_id, r.html) for r in pages]))


def test_odd_rows(spark, tmp_path):
    rows = [(1, "u", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "line\r\nbreak", None), (4, "", ""), (5, "x", "y" * 500_000), (5, "x", "y" * 500_000), (None, "n", "alone"), (None, "n", None), (6, "x", "y" * 500_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit("x").alias(c) for c in [*EXTRA, "payload", "id", "least", "n"]])
    warc.archive_pages(pages, str(tmp_path / "a"))
    assert sorted(rows_of(warc.archived_pages(spark, str(tmp_path / "a"))), key=str) == sorted(plain([(r[0], r[2]) for r in rows]), key=str)
    warc.archive_pages(pages.limit(0), str(tmp_path / "b"))
    assert warc.archived_pages(spark, str(tmp_path / "b")).count() == 0


def test_least_bytes(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    warc.archive_pages(pages, str(tmp_path / "a"), least_bytes=3)
    assert [r[3] for r in sorted(rows_of(warc.archived_pages(spark, str(tmp_path / "a"))))] == ["response"] * 3 + ["revisit"]


def test_both_encodings_splits_and_pushdown(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SPLIT_BYTES", 2000)
    warc.register(spark)
    rows = [(f"<urn:page:{i}>", "revisit" if i % 3 == 0 else "response", f"http://h{i % 5}/{i}", "00" * 20, "<urn:page:1>", f"body {i} \r\n\r\n" * (i % 90)) for i in range(300)]
    frame = spark.createDataFrame(rows, "record_id string, record_type string, target_uri string, sha1_hex string, refers_to string, payload string")
    for compression in ("gzip", "none"):
        path = str(tmp_path / compression)
        writer = warc.WarcWriter(path, compression == "gzip", "2020-01-01T00:00:00Z")
        done = writer.write(iter(frame.toArrow().to_batches()))
        assert len(done.splits) > 2
        writer.write(iter(frame.toArrow().to_batches()))  # a task that ran twice: its file isn't committed
        writer.commit([done])
        read = spark.read.format("warc").load(path)
        got = {r.record_id: bytes(r.payload).decode() for r in read.collect()}
        assert got == {r[0]: r[5] for r in rows}
        some = read.filter("record_type = 'revisit' and target_uri like 'http://h2/%' and record_id in ('<urn:page:12>', '<urn:page:27>', '<urn:page:13>')")
        assert sorted(r.record_id for r in some.collect()) == ["<urn:page:12>", "<urn:page:27>"]


def test_unwanted_payloads_are_not_inflated(tmp_path, monkeypatch):
    made = b"".join(warc.gzip_member(warc.encode_record({"WARC-Type": kind, "WARC-Record-ID": kind}, b"z" * 100_000)) for kind in ("response", "warcinfo", "response"))
    (tmp_path / "x.warc.gz").write_bytes(made)
    seen = []
    block = warc._Gzip.block
    monkeypatch.setattr(warc._Gzip, "block", lambda self, n: seen.append(n) or block(self, n))
    reader = warc.WarcReader(str(tmp_path), True)
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "warcinfo")])) == []
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == 1 and seen == [100_000]


def test_other_writers_gzip(tmp_path):
    """Members without the length subfield, as other tools write them."""
    data = [warc.encode_record({"WARC-Type": "resource", "WARC-Record-ID": str(i)}, b"q" * i * 5000) for i in range(20)]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(gzip.compress(d) for d in data))
    (tmp_path / "y.warc").write_bytes(b"".join(data))
    reader = warc.WarcReader(str(tmp_path), True)
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted((int(r["record_id"]), len(r["payload"])) for r in got) == sorted(2 * [(i, i * 5000) for i in range(20)])
    skipping = warc.WarcReader(str(tmp_path / "x.warc.gz"), False)
    assert sum(b.num_rows for p in skipping.partitions() for b in skipping.read(p)) == 20
