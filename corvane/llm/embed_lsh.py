"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations, with multiprobe.

A table's hash is two rotations x -> H D3 H D2 H D1 x (random signs D, Hadamard H); each gives the index and sign
of the largest component of the result. A vector is at home in one bucket of each table and probes the buckets
of its next best choices; a pair is a candidate where one's home is the other's home or probe, and is verified
by its cosine in double precision. Equal vectors are one row with a count, so only different ones meet.

Every link must be counted once although a pair may meet in many buckets: each row carries its homes and
probes, and a pair counts only in the first bucket (by table, then bucket number) in which it can meet. A group
hands on one row for each member: its counted links and the smallest member of its component there, never pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.shared import Scratch, connected_components

#: Members of a bucket that are compared with each other in one group of a task.
BLOCK = 1024


def rotations(dim: int, count: int, seed: int) -> np.ndarray:
    """Signs of three diagonal matrices for each rotation, over the next power of two."""
    full = 1 << max(0, dim - 1).bit_length()
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (count, 3, full))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, normalised."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def buckets(x: np.ndarray, tables: int, probes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(homes [n, tables], probes [n, tables, probes]) of unit vectors, as int32 bucket numbers."""
    signs = rotations(x.shape[1], 2 * tables, seed)
    full = signs.shape[2]
    padded = np.zeros((len(x), full))
    padded[:, : x.shape[1]] = x
    homes, probed = np.empty((len(x), tables), np.int32), np.empty((len(x), tables, probes), np.int32)
    deep = min(probes + 1, 2 * full)
    for t in range(tables):
        halves = []
        for r in signs[2 * t : 2 * t + 2]:
            y = padded
            for d in r:
                y = hadamard(y * d)
            both = np.concatenate((y, -y), axis=1)
            best = np.argsort(-both, axis=1, kind="stable")[:, :deep]
            halves.append((best, np.take_along_axis(both, best, 1)))
        (i, a), (j, b) = halves
        number = (i[:, :, None] * (2 * full) + j[:, None, :]).reshape(len(x), -1)
        loss = ((a[:, :1] - a)[:, :, None] + (b[:, :1] - b)[:, None, :]).reshape(len(x), -1)
        order = np.argsort(loss, axis=1, kind="stable")[:, : probes + 1]
        picked = np.take_along_axis(number, order, 1)
        if picked.shape[1] <= probes:
            picked = np.concatenate((picked, np.full((len(x), probes + 1 - picked.shape[1]), -1)), axis=1)
        homes[:, t], probed[:, t] = picked[:, 0], picked[:, 1:]
    return homes, probed


def unit(x: np.ndarray) -> np.ndarray:
    """Rows in double precision scaled to length 1; the largest component first, so that no square overflows."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def bucket_type(dim: int) -> type:
    """The narrowest integers that hold the bucket numbers of vectors of this length."""
    return np.int16 if 4 * (1 << max(0, dim - 1).bit_length()) ** 2 <= 1 << 15 else np.int32


def near_duplicate_vectors(spark: SparkSession, vectors: DataFrame, threshold: float = 0.93, tables: int = 12, probes: int = 4, seed: int = 5) -> DataFrame:
    """Links between rows with equal, non-null labels and cosine >= threshold.

    vectors(vec_id, embedding array of numbers, label, ...): null, empty and zero vectors and those that hold a
    null or non-finite component, and rows without a label, link with nothing; vectors of different lengths never
    link; rows with a null vec_id are left out; of rows with an equal vec_id the first in order of label and
    embedding counts. Other columns are ignored. Returns one row for each vec_id: vec_id, n_links, component_id
    (the smallest vec_id reachable) and kept. A pair's cosine is always verified, so there is no false link.
    """
    scratch = Scratch(spark, "vectors")
    kind = np.float32 if dict(vectors.dtypes)["embedding"] == "array<float>" else np.float64  # as they come, in half the bytes
    vec = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), F.col("label").cast("string").alias("label")).filter("vec_id is not null")
    vec = vec.groupBy("vec_id").agg(F.min_by(F.struct("e", "label"), F.struct(F.col("label").isNull(), "label", F.col("e").isNull(), "e")).alias("x")).select("vec_id", "x.*")
    finite = ~F.exists("e", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("e", lambda c: c != 0)
    vec = scratch.keep(vec.select("vec_id", F.when(finite & F.col("label").isNotNull(), F.col("e")).alias("e"), "label"), "vectors")
    valid = vec.filter("e is not null")
    groups = valid.groupBy("label", "e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    reps = scratch.keep(groups, "groups")
    rep_of = valid.join(reps, ["label", "e"]).select("vec_id", "rep", "copies")

    def hashed(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            for dim, part in pdf.groupby(pdf["e"].map(len)):
                for i in range(0, len(part), 1024):
                    some = part.iloc[i : i + 1024]
                    x = unit(np.stack(some["e"].to_numpy()))
                    homes, probed = buckets(x, tables, probes, seed)
                    small = bucket_type(dim)
                    where = pa.array([h.tobytes() + p.tobytes() for h, p in zip(homes.astype(small), probed.astype(small), strict=True)], pa.binary())
                    at = np.concatenate((homes[:, :, None], probed), axis=2).reshape(len(some), -1)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * at.shape[1]), pa.array(at.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(some["rep"]), pa.array(some["copies"]), pa.array(some["label"]), pa.array(np.full(len(some), dim)), pa.array([v.tobytes() for v in np.stack(some["e"].to_numpy()).astype(kind)], pa.binary()), where, lists], names=["id", "copies", "label", "dim", "v", "w", "at"])

    rows = scratch.keep(reps.select("rep", "copies", "label", "e").mapInArrow(hashed, "id long, copies long, label string, dim long, v binary, w binary, at array<int>"), "hashes")
    place = rows.select("id", "label", "dim", F.posexplode("at").alias("k", "bucket")).filter("bucket >= 0").select("id", "label", "dim", F.floor(F.col("k") / (probes + 1)).cast("int").alias("t"), "bucket", (F.col("k") % (probes + 1) == 0).alias("home"))
    key = ["label", "dim", "t", "bucket"]
    parts = place.groupBy(*key).agg(F.count("*").alias("c"), F.max("home").alias("any")).filter("c > 1 and any").select(*key, F.ceil(F.col("c") / BLOCK).cast("int").alias("parts"))
    met = place.join(parts, key).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # a block of members meets itself and each other block once
    met = met.withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("part")).alias("p"), F.greatest(p, F.col("part")).alias("q")))))
    met = met.select(*key, "at.p", "at.q", "part", "home", "id").join(rows.select("id", "copies", "v", "w"), "id")

    group = [*key, "p", "q"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; a group may go on in the next batch."""
        rest: pa.Table | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                rest = pa.Table.from_batches([*(rest.to_batches() if rest is not None else []), batch])
            if rest is None or not len(rest):
                continue
            columns = [rest.column(c).to_numpy(zero_copy_only=False) for c in group]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            whole = len(rest) if batch is None else cuts[-1] if len(cuts) else 0
            if not whole:
                continue
            done, rest = rest.slice(0, whole), rest.slice(whole)
            of = {c: done.column(c).to_numpy(zero_copy_only=False) for c in ("t", "bucket", "p", "q", "id", "home", "part", "copies")}
            v, w = done.column("v").to_pylist(), done.column("w").to_pylist()
            found = [in_group(v[a:b], w[a:b], {c: y[a:b] for c, y in of.items()}) for a, b in itertools.pairwise([0, *cuts[cuts < whole], whole])]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], names=["id", "links", "low"])

    def in_group(v: list[bytes], w: list[bytes], of: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The members of one group that have links there: id, links, the smallest member of the component."""
        n, t, bucket, p, q = len(v), int(of["t"][0]), int(of["bucket"][0]), of["p"][0], of["q"][0]
        x = unit(np.frombuffer(b"".join(v), kind).reshape(n, -1))
        at = np.frombuffer(b"".join(w), bucket_type(x.shape[1])).reshape(n, tables * (probes + 1))
        homes, probed = at[:, :tables], at[:, tables:].reshape(n, tables, probes)
        ids, home, part, copies = (of[c] for c in ("id", "home", "part", "copies"))
        order = np.argsort(ids, kind="stable")
        links, low = np.zeros(n, np.int64), np.arange(n)  # low: by place in the order of ids
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)

        first, other = (np.flatnonzero(part == p), np.flatnonzero(part == q)) if p != q else (np.arange(n), np.arange(n))
        for s in range(0, len(first), 256):
            mine = first[s : s + 256]
            ok = (x[mine] @ x[other].T >= threshold) & (home[mine][:, None] | home[other][None, :])
            ok &= (ids[mine][:, None] != ids[other][None, :]) if p != q else (ids[mine][:, None] < ids[other][None, :])
            i, j = np.nonzero(ok)
            for c in range(0, len(i), 65536):
                a, b = mine[i[c : c + 65536]], other[j[c : c + 65536]]
                # a meets b at its home if that is b's home or probe, and the other way round
                at_a = (homes[a, : t + 1] == homes[b, : t + 1]) | (probed[b, : t + 1] == homes[a, : t + 1, None]).any(axis=2)
                at_b = (probed[a, : t + 1] == homes[b, : t + 1, None]).any(axis=2)
                none = np.int32(np.iinfo(np.int32).max)
                here = np.minimum(np.where(at_a[:, t], homes[a, t], none), np.where(at_b[:, t], homes[b, t], none))
                new = ~(at_a[:, :t] | at_b[:, :t]).any(axis=1) & (here == bucket)
                np.add.at(links, a[new], copies[b[new]])
                np.add.at(links, b[new], copies[a[new]])
                u, v = low[rank[a]], low[rank[b]]
                while (differ := u != v).any():  # hang the larger of two roots on the smaller, then go up to the roots
                    u, v = u[differ], v[differ]
                    np.minimum.at(low, np.maximum(u, v), np.minimum(u, v))
                    while ((up := low[low]) != low).any():
                        low = up
                    u, v = low[u], low[v]
        lows = ids[order][low[rank]]
        touched = (links > 0) | (lows != ids)
        return ids[touched], links[touched], lows[touched]

    met = met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *group).sortWithinPartitions(*group)
    found = scratch.keep(met.mapInArrow(compare, "id long, links long, low long"), "found")
    parts_of = connected_components(scratch, found.select(F.col("id").alias("src"), F.col("low").alias("dst")))
    linked = found.groupBy("id").agg(F.sum("links").alias("links")).join(parts_of, "id", "left").select(F.col("id").alias("rep"), "links", "component")
    out = vec.select("vec_id").join(rep_of, "vec_id", "left").join(linked, "rep", "left")
    out = out.select("vec_id", F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links"), F.coalesce("component", "rep", "vec_id").alias("component_id"))
    out = scratch.keep(out.select("*", (F.col("vec_id") == F.col("component_id")).alias("kept")), "result")
    scratch.drop(vec, reps, rows, found)
    return out
