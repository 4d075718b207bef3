"""Near-duplicate documents by MinHash with banding, confirmed on full shingle sets.

Each document gets 2 * `blocks` blocks of `rows` minhashes; a block is a table of the index and its hash the key
in it. A pair of documents of similarity s shares no table with probability (1 - s**rows)**(2 * blocks), which
with the defaults (rows 8, blocks 19) is 6e-6 at 0.85 and 9.3e-4 at 0.80, and falls fast above. A document has one
row a table at most, however many share its blocks.

Steps, each a Spark job over a keyed shuffle:
1. one pass over the texts gives each document its set size, a 128-bit digest of its set and the minhashes;
2. equal sets collapse to their smallest doc_id, so a large group of copies is one row from here on;
3. in each bucket (the sets that share a key) every member is paired with the smallest one; the distinct pairs are verified;
4. buckets in which more than one component is left, one for each set of members, are compared in full, in blocks of bounded size and
   within reach of each other's set size, only across components; what agrees on enough minhashes and on a
   sketch of the smallest shingles, which is the whole set of a short text, is verified.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.shared import Scratch, connected_components, fresh, mix, word_hashes

WORDS = 5
#: Members of a bucket that are compared with each other in one group of a task.
BLOCK = 2048
#: Minhashes whose low bytes are a document's signature, which tells whether a candidate is worth confirming.
SIGNATURE = 112
#: Shingles of a set in its sketch: a comparison of sets up to this size is exact.
SKETCH = 128
#: Shingles of the sets that a task keeps while it confirms pairs.
KEPT = 1 << 19
#: Bits of the map that tells which documents may be needed; it is broadcast (2 MB) whatever the corpus.
MAP_BITS = 1 << 24
#: Pairs that a task gathers before it hands them on.
PAIRS = 65_536
_FEATURES = "doc_id long, text_key long, n_shingles long, set_hi long, set_lo long, blocks array<long>, sig binary, sketch binary"
_MULT = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(WORDS)], np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingles; A-Z lower-cased, words between ASCII white space."""
    h = word_hashes(text.encode("utf-8", "surrogatepass").lower()) if text else np.empty(0, np.uint64)
    if not len(h):
        return h
    if len(h) < WORDS:
        return mix((h * _MULT[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
    n = len(h) - WORDS + 1
    out = np.zeros(n, np.uint64)
    for k in range(WORDS):
        out += h[k : k + n] * _MULT[k]
    return np.unique(mix(out))


def multipliers(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minhashes(s: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """The smallest of each hash function over the set, a slice of shingles at a time; a hash is a product modulo 2**32."""
    low = np.full(len(mult), 0xFFFFFFFF, np.uint32)
    s = (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(s), 2048):
        low = np.minimum(low, (mult[:, None] * s[None, i : i + 2048]).min(axis=1))
    return low


def features(docs: DataFrame, rows: int, blocks: int, seed: int = 11) -> DataFrame:
    """Per text: set size, digest of the set, a key for each of the 2 * blocks blocks of minhashes (its lowest byte is the
    block's number, of 256 at most), the low bytes of the first SIGNATURE minhashes, and the upper halves of the SKETCH smallest shingles."""
    mult, fold = multipliers(2 * rows * blocks, seed), np.array([pow(_MULT[0].item(), k + 1, 1 << 64) for k in range(rows)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(2 * blocks, dtype=np.uint64)
        for batch in batches:
            n, hi, lo, keys, sig, sketch = [], [], [], [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py())
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                hi.append((d >> 64) - (1 << 63))
                lo.append((d & ((1 << 64) - 1)) - (1 << 63))
                low = minhashes(s, mult) if len(s) else np.empty(0, np.uint32)
                sig.append(low[:SIGNATURE].astype(np.uint8).tobytes())
                sketch.append((s[:SKETCH] >> np.uint64(32)).astype(np.uint32).tobytes())
                keys.append((mix((low.reshape(-1, rows) * fold).sum(axis=1, dtype=np.uint64) + number) & ~np.uint64(255) | number).view(np.int64) if len(s) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary()), pa.array(sketch, pa.binary())], names=["doc_id", "text_key", "n_shingles", "set_hi", "set_lo", "blocks", "sig", "sketch"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(run, _FEATURES)


def _flag(rows: DataFrame, key: str, ids: DataFrame, name: str) -> DataFrame:
    """rows with a boolean `name`: true where rows' key is in ids(id), perhaps for others too. A bitmap of hashed ids tells
    it, so that rows needn't be shuffled; a null key gives false."""
    h, part, bits = F.pmod(F.xxhash64(key), F.lit(MAP_BITS)) + 1, fresh(rows.columns, "part"), fresh(rows.columns, "bits")
    of = F.pmod(F.xxhash64("id"), F.lit(MAP_BITS)) + 1
    map_ = ids.select(of.alias("h")).groupBy(F.bitmap_bucket_number("h").alias(part)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias(bits))
    at = F.bitmap_bit_position(h)
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.col(key).isNotNull() & F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return rows.join(F.broadcast(map_), F.bitmap_bucket_number(h) == F.col(part), "left").select(*rows.columns, found.alias(name))


def _may_be_in(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Of rows(id, ...), those whose id is in ids(id) and perhaps others, without a shuffle of rows."""
    name = fresh(rows.columns, "may")
    return _flag(rows, "id", ids, name).filter(F.col(name)).drop(name)


def keep_firsts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs(doc_id, ...) whose doc_id is kept in found, a result of near_duplicates over them.

    A bitmap of the ids that go, and one of the kept ids that it also hits, decide on nearly all rows where they lie;
    only rows that both bitmaps hit are shuffled, so the texts aren't.
    """
    key, out, stay = (fresh(docs.columns, c) for c in ("key", "out", "stay"))
    gone = found.filter("not kept").select(F.col("doc_id").alias("id"))
    spared = _may_be_in(found.filter("kept").select(F.col("doc_id").alias("id")), gone)
    rows = docs.withColumn(key, F.col("doc_id").cast("long")).filter(F.col(key).isNotNull())
    rows = _flag(_flag(rows, key, gone, out), key, spared, stay)
    unsure = rows.filter(F.col(out) & F.col(stay)).join(spared.withColumnRenamed("id", key), key, "left_semi")
    return rows.filter(~F.col(out)).select(docs.columns).union(unsure.select(docs.columns))


def sketch_matrix(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sketches as rows, filled up to SKETCH with the largest value, and their lengths."""
    size = np.array([len(x) // 4 for x in sketches])
    out = np.full((len(sketches), SKETCH), 0xFFFFFFFF, np.uint32)
    out[np.arange(SKETCH) < size[:, None]] = np.frombuffer(b"".join(sketches), np.uint32)
    return out, size


def sketches_near(i: int, j: np.ndarray, matrix: np.ndarray, size: np.ndarray, n: np.ndarray, least: float, slack: float) -> np.ndarray:
    """Which of the sets j may have similarity `least` with set i, as far as the smallest shingles of their union tell.

    Up to the last shingle that both sketches reach, the union is known; if it is all of the union the answer is exact,
    else the share in both may be `slack` standard deviations of a draw without replacement below `least`.
    """
    x, y = matrix[i, : size[i]], matrix[j]
    full = np.uint32(0xFFFFFFFF)
    last = np.minimum(x[-1] if n[i] > size[i] else full, np.where(n[j] > size[j], y[np.arange(len(j)), size[j] - 1], full))
    within = (y <= last[:, None]) & (np.arange(SKETCH) < size[j][:, None])
    both = (within & (x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y)).sum(axis=1)
    union = np.searchsorted(x, last, "right") + within.sum(axis=1) - both
    whole = (n[i] + n[j]) / (1 + least)
    spread = np.sqrt(least * (1 - least) / union * np.maximum(0, 1 - union / whole))
    return both >= (least - slack * spread) * union - 1e-6


def _confirm(scratch: Scratch, docs: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs(a, b), the links: den * intersection >= num * union over the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, room, a_id, a_set = {}, KEPT, None, None
        for batch in batches:
            src, dst = [], []
            for a, ta, b, tb in zip(*batch.columns, strict=True):
                a, b = a.as_py(), b.as_py()
                if a != a_id:
                    a_id, a_set = a, shingle_set(ta.as_py())
                if (y := kept.get(b)) is None:
                    y = shingle_set(tb.as_py())
                    if room < len(y):
                        kept, room = {}, KEPT
                    kept[b] = y
                    room -= len(y)
                both = len(np.intersect1d(a_set, y, assume_unique=True))
                if den * both >= num * (len(a_set) + len(y) - both):
                    src.append(a)
                    dst.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    text = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t"))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    ids = scratch.keep(ids, "ids")
    needed = scratch.keep(_may_be_in(text, ids).join(ids, "id", "left_semi"), "texts")
    both = pairs.join(needed.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b").join(needed.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a")
    links = scratch.keep(both.select("a", "ta", "b", "tb").mapInArrow(run, "src long, dst long"), "links")
    scratch.drop(needed, ids)
    return links


def _deal(open_: DataFrame) -> DataFrame:
    """open_(key, band, id, lab, home) of buckets with several components, dealt into groups (p, q) of two parts of a
    bucket, or one where p = q, that are compared in a task.

    In a bucket of more than BLOCK members, those of its largest component have parts of their own, which only meet the
    parts of the others: the component's rows are repeated for each BLOCK of other members, not for each of its own.
    """
    labs = open_.groupBy("key", "band", "lab").agg(F.count("*").alias("c"), F.max("home").alias("any"))
    many = labs.groupBy("key", "band").agg(F.sum("c").alias("c"), F.max(F.struct("c", "lab")).alias("main"), F.count("*").alias("labs"), F.max("any").alias("any")).filter("labs > 1 and any")
    large, parts = F.col("c") > BLOCK, lambda c: F.ceil(c / BLOCK).cast("int")
    many = many.select("key", "band", F.when(large, F.col("main.lab")).alias("main"), F.when(large, parts(F.col("c") - F.col("main.c"))).otherwise(1).alias("others"), F.when(large, parts(F.col("main.c"))).otherwise(0).alias("mains"))
    of_main, others, mains, h = F.coalesce(F.col("lab") == F.col("main"), F.lit(False)), F.col("others"), F.col("mains"), F.xxhash64("id")
    part = F.when(of_main, others + F.pmod(h, F.greatest(mains, F.lit(1)))).otherwise(F.pmod(h, others)).cast("int")
    meets = F.sequence(F.lit(0), F.when(of_main, others).otherwise(others + mains) - 1)
    rest = open_.join(many, ["key", "band"]).withColumn("part", part)
    groups = F.transform(meets, lambda p: F.struct(F.least(p, F.col("part")).alias("p"), F.greatest(p, F.col("part")).alias("q")))
    return rest.withColumn("at", F.explode(groups)).select("key", "band", "at.p", "at.q", "part", "id", "lab", "home")


def near_duplicates(spark: SparkSession, docs: DataFrame, num: int = 85, den: int = 100, rows: int = 8, blocks: int = 19, slack: float = 4.5) -> DataFrame:
    """Components of documents whose shingle sets have den * intersection >= num * union.

    docs(doc_id, text, ...); other columns are ignored, whatever their names. Returns one row for each doc_id:
    doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id). A null or blank
    text has 0 shingles and is linked with nothing; fewer than five words are one shingle; rows with a null
    doc_id are dropped; of rows with an equal doc_id the one with the largest set counts (of those as large the one
    with the largest digest) and the others take no part. Pairs are looked for on minhashes that agree in at least
    num/den minus `slack` standard deviations and confirmed on full sets.
    """
    scratch = Scratch(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null").withColumn("text_key", F.xxhash64("text"))
    feats = scratch.keep(features(docs, rows, blocks), "features")
    width = min(SIGNATURE, 2 * rows * blocks)
    floor = num / den - slack * float(np.sqrt(num / den * (1 - num / den) / width))
    # one text for each doc_id; where ids don't repeat there is nothing to leave out
    counts = feats.groupBy("doc_id").agg(F.count("*").alias("c"), F.max(F.struct("n_shingles", "set_hi", "set_lo", "text_key")).alias("best")).filter("c > 1")
    repeated = scratch.keep(counts.select("doc_id", F.col("best.text_key").alias("best")), "repeated")
    if not repeated.isEmpty():
        beaten = scratch.keep(feats.select("doc_id", "text_key").join(repeated, "doc_id").filter("text_key <> best").select("doc_id", "text_key").distinct(), "beaten")
        feats = scratch.keep(feats.join(beaten, ["doc_id", "text_key"], "left_anti").dropDuplicates(["doc_id"]), "features")
        docs = docs.join(beaten, ["doc_id", "text_key"], "left_anti")
    # equal sets: one representative each; only groups of several move, as ids and digests
    groups = feats.filter("n_shingles > 0").groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).filter("c > 1")
    groups = scratch.keep(groups.select("set_hi", "set_lo", "rep"), "groups")
    rep_of = scratch.keep(feats.select("doc_id", "set_hi", "set_lo").join(groups, ["set_hi", "set_lo"]).select("doc_id", "rep"), "representatives")
    alone = feats.filter("n_shingles > 0").select("doc_id", "blocks").join(rep_of.filter("doc_id <> rep").select("doc_id"), "doc_id", "left_anti")
    alone = scratch.keep(alone.select("doc_id", "blocks"), "sets")  # signature and sketch don't move with it
    # blocks that at least two sets share
    keys = alone.select(F.col("doc_id").alias("id"), F.explode("blocks").alias("key"))
    counted = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    buckets = scratch.keep(keys.join(counted.select("key", "low"), "key"), "buckets")  # an id is in a bucket once
    scratch.drop(alone, groups)
    every = feats.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "blocks", "sig", "sketch")
    size = _may_be_in(every, buckets.select("id"))  # most documents are in no bucket

    @F.arrow_udf("boolean")
    def near(x: pa.Array, y: pa.Array) -> pa.Array:
        p, q = (np.frombuffer(b"".join(z.to_pylist()), np.uint8).reshape(-1, width) for z in (x, y))
        return pa.array((p == q).sum(axis=1) >= floor * width)

    fits = lambda p, q: (F.least(p, q) * den >= F.greatest(p, q) * num)
    first = buckets.filter("id > low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    first = first.join(size.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("mb")), "b").join(size.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("ma")), "a")
    first = scratch.keep(first.filter(fits(F.col("na"), F.col("nb"))).filter(near("ma", "mb")).select("a", "b"), "stars")
    links = _confirm(scratch, docs, first, num, den)
    labels = scratch.keep(connected_components(scratch, links), "components")
    # what the stars left open
    lab = buckets.select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("lab"))
    mixed = lab.groupBy("key").agg(F.min("lab").alias("lo"), F.max("lab").alias("hi"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).filter("lo < hi")
    # buckets of the same members hold the same pairs: the one of the first table stands for all, and no pair's first table is lost
    mixed = mixed.groupBy("lo", "hi", "c", "x", "y").agg(F.min_by("key", F.col("key").bitwiseAND(255)).alias("key")).select("key")
    step = float(np.log(den / num)) * (1 + 1e-9)  # sets in reach of each other are one band apart at most
    band = F.floor(F.log(F.col("n")) / step)
    bands = F.array(F.struct(band.alias("band"), F.lit(True).alias("home")), F.struct((band + 1).alias("band"), F.lit(False).alias("home")))
    rest = lab.join(mixed, "key").join(size.select("id", "n"), "id").select("key", "id", "lab", F.explode(bands).alias("x")).select("key", "id", "lab", "x.*")
    open_ = scratch.keep(rest, "open")
    scratch.drop(buckets)
    rest = _deal(open_)
    short = F.transform("blocks", lambda x: F.shiftright(x, 32).cast("int"))  # tells the first table but for 1 pair in 10**8
    members = scratch.keep(rest.select("id").distinct(), "members")
    wide = _may_be_in(every, members).withColumn("blocks", short)
    rest = rest.join(wide, "id")  # bounded: about 750 bytes a row

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; a group may go on in the next batch. A pair counts in the first table it shares, by the upper halves of the keys."""
        rest: pa.Table | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                rest = pa.Table.from_batches([*(rest.to_batches() if rest is not None else []), batch])
            if rest is None or not len(rest):
                continue
            group = np.column_stack([rest.column(c).to_numpy() for c in ("key", "band", "p", "q")])
            cuts = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
            whole = cuts[-1] if batch is not None and len(cuts) else 0 if batch is not None else len(rest)
            if not whole:
                continue
            done, rest = rest.slice(0, whole), rest.slice(whole)
            p, q, part, ids, lab_, n, home = (done.column(c).to_numpy(zero_copy_only=False) for c in ("p", "q", "part", "id", "lab", "n", "home"))
            sig, table = np.frombuffer(b"".join(done.column("sig").to_pylist()), np.uint8).reshape(-1, width), done.column("key").to_numpy() & 255
            block = done.column("blocks").combine_chunks().flatten().to_numpy().reshape(-1, 2 * blocks)
            matrix, held = sketch_matrix(done.column("sketch").to_pylist())
            src, dst, gathered = [], [], 0
            for a, b in itertools.pairwise([0, *cuts[cuts < whole], whole]):
                same = p[a] == q[a]
                for i in range(a, b - 1) if same else a + np.flatnonzero(part[a:b] == p[a]):
                    o = slice(i + 1, b) if same else slice(a, b)
                    ok = (lab_[o] != lab_[i]) & (home[o] | home[i]) & (np.minimum(n[o], n[i]) * den >= np.maximum(n[o], n[i]) * num)
                    if not same:
                        ok &= part[o] == q[a]
                    if ok.any():
                        j = o.start + np.flatnonzero(ok)
                        ok = (sig[j] == sig[i]).sum(axis=1) >= floor * width
                        ok[ok] = sketches_near(i, j[ok], matrix, held, n, num / den, slack)
                        j = j[ok]
                        other = ids[j[(block[j] == block[i]).argmax(axis=1) == table[i]]]
                        src.append(np.minimum(ids[i], other))
                        dst.append(np.maximum(ids[i], other))
                        gathered += len(other)
                        if gathered > PAIRS:
                            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (src, dst)], names=["a", "b"])
                            src, dst, gathered = [], [], 0
            if gathered:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (src, dst)], names=["a", "b"])

    group = ["key", "band", "p", "q"]
    second = rest.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *group).sortWithinPartitions(*group).mapInArrow(compare, "a long, b long")
    second = scratch.keep(second.join(first, ["a", "b"], "left_anti"), "pairs")
    more = _confirm(scratch, docs, second, num, den)
    final = scratch.keep(connected_components(scratch, links.union(more)), "final")
    out = feats.select("doc_id", "n_shingles").join(rep_of, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    out = out.join(final.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = scratch.keep(out.select("*", (F.col("doc_id") == F.col("component_id")).alias("kept")), "result")
    scratch.drop(feats, rep_of, first, links, labels, open_, members, second, more, final)
    return out
