"""Immutable containers of content-addressed blobs: written by task, read by footer.

A container is a header, frames, a footer of fixed-size entries and a trailer with the footer's length, its SHA-256
and a magic. Blobs are compressed with zstd where that saves 3 % or more. Files are read through Spark's binaryFile
source and written through pyarrow's file systems; each attempt of a task writes a file of its own and the committed
manifest names those that count.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.crc32c import crc32c

#: Fixed values of the format.
HEADER, TRAILER_MAGIC, ENTRY, TRAILER = b"MVPK\x01\x00", b"KPVM", 61, 40
COMPRESSED, LEAST_COMPRESSED, MAX_STORED, MAX_RAW = 1, 1024, 64 << 20, 1 << 32
FOOTER = "path string, pack_id string, hash string, offset long, stored_len long, raw_len long, flags int, crc32c long, problem string"


def frame(raw: bytes, level: int = 3) -> tuple[bytes, int]:
    """(stored bytes, flags): compressed only if at least 3 %, rounded up, and one byte are saved."""
    import zstandard

    if len(raw) >= LEAST_COMPRESSED:
        small = zstandard.ZstdCompressor(level=level).compress(raw)
        if len(small) <= len(raw) - max(1, -(-len(raw) * 3 // 100)):
            return small, COMPRESSED
    return raw, 0


def seal(blobs: list[bytes]) -> bytes:
    """A container of the blobs in order."""
    data, entries = bytearray(HEADER), []
    for raw in blobs:
        stored, flags = frame(raw)
        entries.append(hashlib.sha256(raw).digest() + struct.pack("<QQQBI", len(data), len(stored), len(raw), flags, crc32c(stored)))
        data += stored
    footer = struct.pack("<I", len(entries)) + b"".join(entries)
    signed = footer + struct.pack("<I", len(footer))
    return bytes(data) + signed + hashlib.sha256(signed).digest() + TRAILER_MAGIC


def footer_entries(content: bytes) -> tuple[list[tuple], str | None]:
    """(entries, problem) of a whole container; a problem means that no entry can be trusted."""
    if len(content) < len(HEADER) + 4 + TRAILER:
        return [], "truncated"
    tail = content[-TRAILER:]
    if tail[36:] != TRAILER_MAGIC or content[:4] != HEADER[:4]:
        return [], "magic"
    (size,) = struct.unpack_from("<I", tail)
    start = len(content) - TRAILER - size
    if start < len(HEADER):
        return [], "truncated"
    region = content[start : start + size]
    if hashlib.sha256(region + tail[:4]).digest() != tail[4:36]:
        return [], "checksum"
    if size < 4 or size != 4 + ENTRY * struct.unpack_from("<I", region)[0]:
        return [], "footer size"
    out = []
    for at in range(4, size, ENTRY):
        offset, stored, raw, flags, crc = struct.unpack_from("<QQQBI", region, at + 32)
        if flags & ~3:
            return [], "flags"
        if stored > MAX_STORED + (1 << 16) or raw > MAX_RAW:
            return [], "length"
        if offset < len(HEADER) or offset + stored > start:
            return [], "span"
        out.append((region[at : at + 32].hex(), offset, stored, raw, flags, crc))
    return out, None


def blob_of(stored: bytes, raw_len: int, flags: int, crc: int, digest: str) -> tuple[bytes | None, str | None]:
    """(raw bytes, problem): CRC of what is stored, then decoding, then the digest of what came out."""
    import zstandard

    if crc32c(stored) != crc:
        return None, "crc32c"
    if flags & ~COMPRESSED:
        return None, "encrypted"
    try:
        raw = zstandard.ZstdDecompressor().decompress(stored, max_output_size=raw_len) if flags & COMPRESSED else stored
    except zstandard.ZstdError:
        return None, "zstd"
    if len(raw) != raw_len or hashlib.sha256(raw).hexdigest() != digest:
        return None, "digest"
    return raw, None


def write_containers(spark: SparkSession, blobs: DataFrame, path: str, target: int = 32 << 20) -> DataFrame:
    """Write blobs(content binary) into containers of about target bytes; returns the manifest (path, entries, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task, held, size, n = TaskContext.get(), [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, n
            store, folder = fs.FileSystem.from_uri(path)
            store.create_dir(folder, recursive=True)
            name, content = f"{task.partitionId():05d}-{task.taskAttemptId()}-{n}.pack", seal(held)
            with store.open_output_stream(f"{folder}/{name}") as f:
                f.write(content)
            row = pa.RecordBatch.from_pydict({"path": [f"{path}/{name}"], "entries": [len(held)], "bytes": [len(content)]})
            held, size, n = [], 0, n + 1
            return row

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                if raw is not None:
                    held.append(raw)
                    size += len(raw)
                    if size >= target:
                        yield flush()
        if held:
            yield flush()

    blobs.select("content").mapInArrow(run, "path string, entries long, bytes long").write.parquet(f"{path}-manifest")
    return spark.read.schema("path string, entries long, bytes long").parquet(f"{path}-manifest")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pack").load(path).select("path", "content")


def read_footers(spark: SparkSession, path: str) -> DataFrame:
    """Entries of every container under path; a damaged container gives one row with its problem."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FOOTER.split(", ")]
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                pack = p.rpartition("/")[2].rpartition(".")[0]
                entries, problem = footer_entries(content)
                rows += [(p, pack, *e, None) for e in entries] if problem is None else [(p, pack, None, None, None, None, None, None, problem)]
            yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("offset", "stored_len", "raw_len", "flags", "crc32c")})

    return _files(spark, path).mapInPandas(run, FOOTER)


def read_blobs(spark: SparkSession, path: str, check_only: bool = False) -> DataFrame:
    """Blobs of every container: path, hash, content (null with check_only or a problem), problem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                entries, problem = footer_entries(content)
                rows = [] if problem is None else [(p, None, None, problem)]
                for digest, offset, stored, raw, flags, crc in entries:
                    part = content[offset : offset + stored]
                    got, wrong = (None, None if crc32c(part) == crc else "crc32c") if check_only else blob_of(part, raw, flags, crc, digest)
                    rows.append((p, digest, got, wrong))
                yield pa.RecordBatch.from_pylist([dict(zip(("path", "hash", "content", "problem"), r, strict=True)) for r in rows], schema=pa.schema([("path", pa.string()), ("hash", pa.string()), ("content", pa.binary()), ("problem", pa.string())]))

    return _files(spark, path).mapInArrow(run, "path string, hash string, content binary, problem string")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Paths under a store relative to it, without the files' contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.select(F.regexp_replace("path", f"^(?:file:/*)?/?{path.removeprefix('file://').lstrip('/').rstrip('/')}/", "").alias("path"), "length")
