"""WARC archives: a writer of one gzip member for each record and a splittable reader.

Reading needs no index and no cooperation between tasks. A task has a range of bytes of one file. It looks for
the gzip magic from the range's first byte on, accepts a candidate only if the member starting there decodes to a
WARC header, and from there follows member after member; the records whose member starts inside the range are
its own, the last of which may end far behind it. A record is thus read by exactly one task, whatever the ranges.

Files are written and read through pyarrow's file systems (file, hdfs, s3, gs), as Spark has no writer for them.
Each attempt of a task writes a file of its own; the manifest, a table that Spark commits, names the files of the
attempts that counted, so a lost executor or a second attempt leaves no record twice.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.shared import Scratch

MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 20
ID = "urn:corvane:page:"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def record_bytes(page_id: int, url: str | None, payload: bytes | None, size: int, sha1: str, refers_to: int | None) -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit (refers_to is set) without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"" if refers_to is None else b"")
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"{ID}{page_id}"
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID}{page_id}>", f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{ID}{refers_to}>"]
    z = zlib.compressobj(6, wbits=31)
    return z.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


_NAMED = re.compile(r"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*(.*?)[ \t]*")


def header_of(data: bytes) -> dict[str, str] | None:
    """The fields of a decoded member's header by lower-cased name; None unless it begins a valid record.

    A record has a version line and the fields WARC-Type, WARC-Record-ID and Content-Length, and the member holds as many
    bytes as the last one says. Names are matched in any case, a line that begins with white space goes on with the field
    before it, and of repeated fields the last counts.
    """
    head, end, rest = data.partition(b"\r\n\r\n")
    version, *lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")
    fields = {m[1].lower(): m[2] for m in map(_NAMED.fullmatch, lines) if m}
    if not end or not re.fullmatch(r"WARC/\d+\.\d+", version) or not fields.get("warc-type") or not fields.get("warc-record-id"):
        return None
    size = fields.get("content-length", "")
    return fields if re.fullmatch(r"[0-9]{1,18}", size) and int(size) <= len(rest) else None


def parse_record(data: bytes) -> tuple:
    """(page_id, url, type, refers_to, payload bytes, payload digest, payload) of a decoded member that header_of accepts.

    Records of any writer: page_id and refers_to are null where the ids aren't those of this module, url where there is no
    target. The payload is the HTTP body, or the whole block where its content type isn't HTTP. A revisit has no payload;
    its size is that of its HTTP header, else null, its digest that of its header, else null.
    """
    fields = header_of(data)
    block = data.partition(b"\r\n\r\n")[2][: int(fields["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")

    def page(name: str) -> int | None:
        number = fields.get(name, "").strip("<>").removeprefix(ID)
        return int(number) if fields.get(name, "").strip("<>").startswith(ID) and re.fullmatch(r"-?[0-9]{1,19}", number) else None

    kind, is_http = fields["warc-type"].lower(), fields.get("content-type", "").lower().startswith("application/http")
    if kind == "revisit":
        size, digest, payload = re.search(rb"(?i)(?:^|\r\n)content-length:[ \t]*(\d+)", http), fields.get("warc-payload-digest", ""), None
        size, digest = int(size[1]) if size else None, digest.removeprefix("sha1:") if digest.startswith("sha1:") else None
    else:
        payload = body if is_http else block
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return page("warc-record-id"), fields.get("warc-target-uri"), kind, page("warc-refers-to"), size, digest, payload


def records_in(stream, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of every member that starts in [start, end) and decodes to a valid WARC record."""
    stream.seek(start)
    buf, base, at = b"", start, start

    def more() -> bool:
        nonlocal buf, base
        new = stream.read(BLOCK)
        buf, base = buf[at - base :] + new, at
        return bool(new)

    def member() -> tuple[bytes, int] | None:
        """What the member at `at` holds and where it ends; None if there is none or it isn't a record."""
        z, data, used = zlib.decompressobj(31), bytearray(), 0
        while not z.eof:
            if at - base + used >= len(buf) and not more():
                return None
            part = buf[at - base + used : at - base + used + 65536]
            try:
                data += z.decompress(part)
            except zlib.error:
                return None
            used += len(part) - len(z.unused_data)
            if data and not data.startswith(b"WARC/"[: len(data)]):
                return None
        return (bytes(data), at + used) if header_of(bytes(data)) is not None else None

    while at < end:
        i = buf.find(MAGIC, at - base)
        if i < 0:
            at = max(at, base + len(buf) - 2)  # the magic may go on in the next block
            if not more():
                return
            if len(buf) < 3:
                return
            continue
        at = base + i
        if at >= end:
            return
        if (found := member()) is None:
            at += 1
            continue
        yield at, found[0]
        at = found[1]


def write_archives(spark: SparkSession, pages: DataFrame, path: str, dedup_bytes: int = 1000) -> DataFrame:
    """Write a record for every row and return the manifest (path, records, bytes).

    pages(page_id, url, html, ...): a null html is an empty payload, a null url gets the page's own URN, rows with
    a null page_id are left out, other columns are ignored. Of rows with equal payloads of at least dedup_bytes
    bytes, the one with the largest page_id is a response, the others revisit it; every other row is a response.
    Only digests are grouped; payloads move once, by page_id, so a payload that a third of all rows share is no
    hot key. An empty table gives an empty manifest and no files.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).filter("page_id is not null")
    keyed = rows.select("page_id", F.octet_length("payload").alias("n"), F.sha2("payload", 256).alias("sha"))
    long = keyed.filter(F.col("n") >= dedup_bytes)
    target = long.groupBy("sha", "n").agg(F.max("page_id").alias("target"), F.count("*").alias("c")).filter("c > 1")
    revisit = long.join(target, ["sha", "n"]).filter("page_id < target").select("page_id", "sha", "target").distinct()
    data = rows.withColumn("sha", F.sha2("payload", 256)).join(revisit, ["page_id", "sha"], "left")
    data = data.select("page_id", "url", F.when(F.col("target").isNull(), F.col("payload")).alias("payload"), F.octet_length("payload").alias("n"), F.sha1("payload").alias("sha1"), "target")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = name = out = None
        records = size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs, folder = _open(path)
                    fs.create_dir(folder, recursive=True)
                    task = TaskContext.get()
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                got = record_bytes(*row)
                out.write(got)
                records, size = records + 1, size + len(got)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{path}/{name}"], "records": [records], "bytes": [size]})

    data.mapInArrow(run, "path string, records long, bytes long").write.parquet(f"{path}-manifest")
    return spark.read.schema("path string, records long, bytes long").parquet(f"{path}-manifest")


def read_archives(spark: SparkSession, files: DataFrame, split_bytes: int = 16 << 20, payloads: bool = True) -> DataFrame:
    """The records of files(path, bytes), read in ranges of split_bytes.

    Returns page_id, url, record_type, refers_to, payload_bytes, payload_digest (lower-case hex SHA-1), payload
    (null for revisits, or everywhere with payloads=False). Bytes that are no member of a valid record are passed over.
    Every record gives a row, those of other writers and types too (see parse_record for what is null then).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        for pdf in batches:
            for path, start, end in zip(pdf["path"], pdf["start"], pdf["end"], strict=True):
                fs, name = _open(path)
                rows, held = [], 0
                with fs.open_input_file(name) as f:
                    for _, data in records_in(f, start, end):
                        rows.append(parse_record(data))
                        held += len(data) if payloads else 500
                        if not payloads:
                            rows[-1] = (*rows[-1][:-1], None)
                        if held > 8 << 20:
                            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    parts = files.filter("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"), "bytes").select("path", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"))
    return parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(run, RECORD)


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the archives to the shared folder and read the records back, without their payloads."""
    path = Scratch(spark, "warc").path("archives")
    return read_archives(spark, write_archives(spark, pages, path), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
