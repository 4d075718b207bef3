"""What the operators of this subpackage share: scratch tables, a worker's one kept model, word hashing, components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch between the JVM and a Python worker, where the session doesn't say otherwise.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one takes its place only in local mode, where all is one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold BATCH_BYTES or one row, so that long texts don't fill a worker; a user's own setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def fresh(columns: Iterable[str], name: str) -> str:
    """name, or name with underscores before it until no column is called so; Spark ignores case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


_held: dict[Hashable, Any] = {}


def held(key: Hashable, build: Callable[[], Any]) -> Any:
    """What build() gives, kept by this Python worker for its next tasks until another key is asked for.

    One slot for all operators: a worker that Spark passes from stage to stage never holds the models of two.
    """
    if key not in _held:
        _held.clear()
        give_back()
        _held[key] = build()
        give_back()
    return _held[key]


def give_back() -> None:
    """Return what this process has freed to the system, as far as its allocators let it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def path(self, tag: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{tag}"

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        """Write df and return a DataFrame that reads it back; its folder is in the attribute corvane_path."""
        path = self.path(tag)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.corvane_path = path
        return out

    def drop(self, *frames: DataFrame | str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for x in frames:
            path = jvm.org.apache.hadoop.fs.Path(x if isinstance(x, str) else x.corvane_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Memo(dict):
    """What compute gave for a key. Two generations of at most `most` keys: what was used of late stays.

    Keys longer than `longest` are computed each time, so that memory has a bound.
    """

    def __init__(self, compute: Callable, most: int = 100_000, longest: int = 64):
        super().__init__()
        self.compute, self.most, self.longest, self.old = compute, most, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.compute(key)
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values: a bijection in which every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


#: Bytes of a text that are worked on at once; a cut is made between words only.
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: Of a byte whether it is ASCII white space.
IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: A random number for each place in a word, modulo 64, and byte; 0 for white space.
_AT = np.where(IS_SPACE, 0, mix(np.arange(64 * 256, dtype=np.uint64) + np.uint64(0x5EED << 32)).reshape(64, 256)).ravel()


def pieces(data: bytes) -> Iterator[bytes]:
    """data cut at white space into pieces of PIECE bytes, or more where a word is longer."""
    i = 0
    while len(data) - i > PIECE and (m := _SPACE.search(data, i + PIECE)):
        yield data[i : m.start()]
        i = m.start()
    yield data[i:] if i else data


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word between ASCII white space, the same in every process.

    It is the sum of the random numbers of its bytes at their places, each times an odd number that counts blocks of 64 places.
    """
    out = []
    for piece in pieces(data):
        b = np.frombuffer(piece, np.uint8)
        word = ~IS_SPACE[b]
        starts = np.flatnonzero(word[1:] & ~word[:-1]) + 1
        if len(word) and word[0]:
            starts = np.concatenate(([0], starts))
        if len(starts):
            at = np.arange(starts[0], len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
            values = _AT.take((at & 63) << 8 | b[starts[0] :])
            if at.max() > 63:
                values = values * ((at >> 6 << 1) + 1).astype(np.uint64)
            out.append(np.add.reduceat(values, starts - starts[0]))
    return mix(np.concatenate(out)) if out else np.empty(0, np.uint64)


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Components of an undirected graph.

    edges(src long, dst long) in any direction, repeated or looped; returns (id, component) with one row
    for each end of an edge that is no loop and component the smallest id reachable. Each round hangs every
    node's neighbours on the smallest of them (first the larger ones, then the smaller ones), which are two
    aggregations and two joins on a node; rounds end when nothing changes. A hot node is pre-aggregated in
    the aggregation and split by adaptive execution in the join.
    """

    def hang(e: DataFrame, upward: bool) -> DataFrame:
        both = e.select("src", "dst").union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if upward else e
        least = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
        if upward:
            j = both.filter(F.col("dst") > F.col("src")).join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        else:
            j = both.join(least, "src").select(F.explode(F.array(F.struct(F.col("dst").alias("src"), F.col("low").alias("dst")), F.struct("src", F.col("low").alias("dst")))).alias("e")).select("e.src", "e.dst")
        return j.filter(F.col("src") > F.col("dst")).distinct()

    now = scratch.keep(
        edges.filter(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(),
        "edges",
    )
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen[0]:
        then = scratch.keep(hang(hang(now, True), False), "stars")
        scratch.drop(now)
        now, was, seen = then, seen, mark(then)
        if was == seen:
            break
    return now.select(F.col("src").alias("id"), F.col("dst").alias("component")).union(now.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct())
