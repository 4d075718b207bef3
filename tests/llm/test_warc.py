"""Archives: ranges of every size own each record once; odd payloads and urls come back."""

import gzip
import hashlib
import io
import random

from corvane.llm import warc

PAGES = "page_id long, url string, html string, payload int"


def brute(rows):
    out = {}
    for i, _, html, _ in rows:
        b = (html or "").encode()
        same = [j for j, _, h, _ in rows if (h or "").encode() == b]
        revisit = len(b) >= 1000 and i < max(same)
        out[i] = (len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None)
    return out


def test_round_trip(spark):
    r = random.Random(3)
    big = "é" * 700
    rows = [(1, "http://a/", None, 0), (2, None, "", 0), (3, "http://a/\r\nWARC-Type: x", "x\r\n\r\ny", 0), (4, "u", big, 0), (5, "u", big, 0), (6, "u", big, 0), (7, "u", "y" * 999, 0), (8, "u", "y" * 999, 0), (9, "u", "z" * 1000, 0), (10, "u", "z" * 1000, 0)]
    rows += [(k, f"http://h/{k}", "".join(r.choice("ab \n<>é") for _ in range(r.randint(0, 4000))), 0) for k in range(20, 90)]
    df = spark.createDataFrame(rows, PAGES)
    got = {x.page_id: (x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in warc.archive_round_trip(spark, df).collect()}
    assert got == brute(rows)
    assert warc.archive_round_trip(spark, df.filter("false")).count() == 0


def test_ranges_of_any_size(spark, tmp_path):
    rows = [(k, f"http://h/{k}", f"page {k} " * (k % 50), 0) for k in range(60)]
    files = warc.write_archives(spark, spark.createDataFrame(rows, PAGES).coalesce(1), f"file://{tmp_path}/w")
    for step in (37, 500, 100_000):
        got = warc.read_archives(spark, files, step).collect()
        assert sorted(x.page_id for x in got) == list(range(60))
        assert {x.page_id: bytes(x.payload).decode() for x in got} == {k: h for k, _, h, _ in rows}


def test_false_magic_and_damage():
    one = warc.record_bytes(1, "u", b"x", 1, hashlib.sha1(b"x").hexdigest(), None)
    two = warc.record_bytes(2, "u", None, 5, "d", 1)
    other = gzip.compress(b"not a record")
    data = b"junk" + warc.MAGIC + b"\0\0" + one + other + two + warc.MAGIC
    got = [(at, warc.parse_record(d)) for at, d in warc.records_in(io.BytesIO(data), 0, len(data))]
    assert [x[1][0] for x in got] == [1, 2] and got[1][1][2:6] == ("revisit", 1, 5, "d")
    assert [x[0] for x in warc.records_in(io.BytesIO(data), got[0][0] + 1, len(data))] == [got[1][0]]
    assert list(warc.records_in(io.BytesIO(b""), 0, 10)) == []


def member(head, block):
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_records_of_other_writers():
    uuid = "<urn:uuid:00000000-0000-0000-0000-000000000001>"
    info = member(["WARC/1.0", "WARC-Type: warcinfo", f"WARC-Record-ID: {uuid}", "Content-Length: 4"], b"a: b")
    lower = member(["WARC/1.1", "warc-type:RESPONSE", f"warc-record-id:{uuid}", "content-type:application/http", "warc-target-uri:  http://x/", "content-length:22"], b"HTTP/1.1 200 OK\r\n\r\nxyz")
    short = member(["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: {uuid}", "Content-Length: 999"], b"cut")
    nothing = [member(["WARC/1.1", "WARC-Type: response", "Content-Length: 1"], b"x"), member(["WARC/x", "WARC-Type: a", f"WARC-Record-ID: {uuid}", "Content-Length: 1"], b"x"), member(["WARC/1.1", "WARC-Type: a", f"WARC-Record-ID: {uuid}", "Content-Length: -1"], b"x"), gzip.compress(b"WARC/1.1")]
    data = info + short + b"".join(nothing) + lower
    got = [warc.parse_record(d) for _, d in warc.records_in(io.BytesIO(data), 0, len(data))]
    assert got[0] == (None, None, "warcinfo", None, 4, hashlib.sha1(b"a: b").hexdigest(), b"a: b")
    assert got[1] == (None, "http://x/", "response", None, 3, hashlib.sha1(b"xyz").hexdigest(), b"xyz") and len(got) == 2
