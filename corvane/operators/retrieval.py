"""Retrieval: nearest neighbours, coverage, roll-up, fusion of ranked lists, incremental fill.

Ranked lists are DataFrames (gen_pos, doc, chunk_index, score float, pos); positions are columns, so that ties
resolve the same way however the rows are dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import blank, split_chunks
from corvane.functions.vectors import cosine_to


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k vectors of largest cosine, ties by id: id, score (float). One heap per partition, no sort of all rows."""
    scored = vectors.select(*[c for c in vectors.columns if c != vector_col], cosine_to(query, F.col(vector_col)).cast("float").alias("score"))
    return scored.filter("score is not null").orderBy(F.desc("score"), id_col).limit(k)


def covered(embed_gen: Column, stamp_doc: Column, revision: Column | None = None, stamp_revision: Column | None = None) -> Column:
    """Whether a document's vectors of a generation are current: never null, so that its negation is safe."""
    out = embed_gen.isNotNull() & stamp_doc.isNotNull()
    return out if revision is None else out & revision.eqNullSafe(stamp_revision)


def with_stamps(docs: DataFrame, stamps: DataFrame, ordinal: int) -> DataFrame:
    """docs(doc, embed_gen, revision) with `is_covered` for one generation."""
    s = stamps.filter(F.col("ordinal") == ordinal).select(F.col("doc").alias("s_doc"), F.col("revision").alias("s_revision"))
    joined = docs.join(s, F.col("doc") == F.col("s_doc"), "left")
    return joined.withColumn("is_covered", covered(F.col("embed_gen"), F.col("s_doc"), F.col("revision"), F.col("s_revision"))).drop("s_doc", "s_revision")


def nearest_covered(vectors: DataFrame, query: list[float], k: int, docs: DataFrame, stamps: DataFrame, ordinal: int) -> DataFrame:
    """Nearest chunks of current documents: stale vectors take their places among the k before they are left out.

    vectors(vec_id, embedding, doc, chunk_index). The k rows are broadcast: their number is the limit itself.
    """
    top = F.broadcast(nearest(vectors, query, k))
    return with_stamps(docs, stamps, ordinal).join(top, "doc").filter("is_covered").select("vec_id", "doc", "chunk_index", "score")


def pending(docs: DataFrame, stamps: DataFrame, ordinal: int, limit: int | None = None) -> DataFrame:
    """Documents that a generation doesn't cover, by doc; null content is empty."""
    out = with_stamps(docs, stamps, ordinal).filter(~F.col("is_covered")).drop("is_covered").withColumn("content", F.coalesce("content", F.lit("")))
    return out if limit is None else out.orderBy("doc").limit(limit)


def rollup_by_document(hits: DataFrame) -> DataFrame:
    """Best chunk of each document of each list, first seen on ties, documents by score and then first seen: adds rank from 0."""
    best = hits.groupBy("gen_pos", "doc").agg(F.max_by(F.struct("chunk_index", "score"), F.struct("score", -F.col("pos"))).alias("b"), F.min("pos").alias("first_pos")).select("gen_pos", "doc", "b.*", "first_pos")
    order = Window.partitionBy("gen_pos").orderBy(F.desc("score"), "first_pos")
    return best.withColumn("rank", F.row_number().over(order) - 1)


def merge(lists: DataFrame, how: str = "raw", limit: int = 0, rrf_k: int = 60) -> DataFrame:
    """Union of rolled-up lists (gen_pos, doc, chunk_index, score, rank); a document of several counts from the earliest.

    raw keeps its score there; normalized puts each whole list to 0..1 first (1 if all are equal); rrf sums
    1 / (k + rank + 1) over all lists. By float score, then list, then rank; limit <= 0 is all.
    """
    if how == "normalized":
        span = Window.partitionBy("gen_pos")
        lo, hi = F.min("score").over(span), F.max("score").over(span)
        lists = lists.withColumn("value", F.when(hi - lo > 0, (F.col("score") - lo).cast("double") / (hi - lo).cast("double")).otherwise(1.0))
    elif how == "rrf":
        k = rrf_k if rrf_k > 0 else 60
        lists = lists.withColumn("value", 1.0 / (F.lit(k) + F.col("rank") + 1))
    else:
        lists = lists.withColumn("value", F.col("score").cast("double"))
    first = F.struct("gen_pos", "rank")
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("gen_pos", "value"))), F.lit(0.0), lambda s, x: s + x["value"])
    value = total if how == "rrf" else F.min_by("value", first)
    out = lists.groupBy("doc").agg(F.min_by(F.struct("gen_pos", "rank", "chunk_index"), first).alias("f"), value.cast("float").alias("score")).select("doc", "f.*", "score")
    order = [F.desc("score"), F.col("gen_pos"), F.col("rank")]
    return out.orderBy(*order).limit(limit) if limit > 0 else out


def live_generations(generations: DataFrame) -> DataFrame:
    """Building generations first, then active ones, by ordinal: adds gen_pos."""
    live = generations.filter(F.col("state").isin("building", "active"))
    key = F.struct(F.when(F.col("state") == "building", 0).otherwise(1), F.col("ordinal"))
    return live.withColumn("gen_pos", F.row_number().over(Window.orderBy(key)) - 1)  # a handful of generations


def chunks(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    return docs.select("doc", F.explode(split_chunks(F.col("content"), size, overlap)).alias("c")).select("doc", F.col("c.idx").alias("chunk_index"), "c.text")


def encode_batches(refs: DataFrame, size: int, step: int = 1 << 16) -> DataFrame:
    """Consecutive chunks in batches of `size`, numbered by (doc, chunk_index), and the slice of each document in them.

    The global number comes from each document's count of chunks: running sums within stretches of `step` numbers of doc,
    which is an integer, and over one row for each stretch. Where ids lie far apart, take a larger step.
    """
    per = refs.groupBy("doc").agg(F.count("*").alias("n")).withColumn("s", F.floor(F.col("doc") / step))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before = per.groupBy("s").agg(F.sum("n").alias("n")).select("s", F.coalesce(F.sum("n").over(upto(Window.orderBy("s"))), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n").over(upto(Window.partitionBy("s").orderBy("doc"))), F.lit(0))
    start = per.withColumn("within", within).join(before, "s").select("doc", (F.col("before") + F.col("within")).alias("start"))
    numbered = refs.withColumn("k", F.row_number().over(Window.partitionBy("doc").orderBy("chunk_index")) - 1).join(start, "doc")
    return numbered.withColumn("batch", F.floor((F.col("start") + F.col("k")) / size)).groupBy("batch", "doc").agg(F.min("chunk_index").alias("first_chunk"), F.count("*").alias("n_chunks"))


def topic_encoder(text: Column, topics: list[str]) -> Column:
    """A stand-in encoder: one-hot of the first topic the text holds, else of one more component."""
    picked = F.coalesce(*[F.when(F.lower(text).contains(t), F.lit(i)) for i, t in enumerate(topics)], F.lit(len(topics)))
    return F.transform(F.sequence(F.lit(0), F.lit(len(topics))), lambda i: F.when(i == picked, 1.0).otherwise(0.0).cast("float"))


def encode(chunks: DataFrame, encoder: Callable[[list[str]], Sequence[Sequence[float]]], dimension: int, batch: int = 64, isolate: bool = True) -> DataFrame:
    """chunks(doc long, chunk_index int, text) encoded in batches inside the tasks: (doc, chunk_index, vector, error).

    encoder gives a vector for each text, in their order. error is null or why there is no vector: blank (found before
    the encoder is called), count (not as many vectors as texts), dimension, invalid (a component isn't finite or all
    are zero), or the name of the exception. If a batch fails and `isolate` is set, each of its documents is tried
    alone, so that one bad text spoils no others; else all of the batch fail. A batch never spans two partitions.
    """

    def tried(texts: list[str]) -> tuple[list | None, list[str | None]]:
        try:
            vectors = encoder(texts)
        except Exception as e:  # whatever a user's encoder raises becomes the rows' error
            return None, [type(e).__name__] * len(texts)
        if len(vectors) != len(texts):
            return None, ["count"] * len(texts)
        errors: list[str | None] = []
        for v in vectors:
            x = np.asarray(v, np.float32)
            errors.append("dimension" if x.shape != (dimension,) else None if np.isfinite(x).all() and x.any() else "invalid")
        return vectors, errors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), batch):
                part = whole.slice(at, batch)
                docs, texts, is_blank = part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()
                out: list[list[float] | None] = [None] * len(texts)
                error: list[str | None] = ["blank" if b else None for b in is_blank]
                todo = [i for i, b in enumerate(is_blank) if not b]
                groups = [todo] if todo else []
                vectors, errors = tried([texts[i] for i in todo]) if todo else ([], [])
                if any(errors) and isolate:
                    groups = [[i for i in todo if docs[i] == d] for d in dict.fromkeys(docs[i] for i in todo)]
                for group in groups:
                    if groups != [todo]:
                        vectors, errors = tried([texts[i] for i in group])
                    first = next((e for e in errors if e), None)
                    for k, i in enumerate(group):
                        error[i] = first
                        out[i] = None if first else [float(x) for x in vectors[k]]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.list_(pa.float32())), pa.array(error, pa.string())], names=["doc", "chunk_index", "vector", "error"])

    rows = chunks.select(F.col("doc").cast("long").alias("doc"), F.col("chunk_index").cast("int").alias("chunk_index"), F.coalesce("text", F.lit("")).alias("text"), blank(F.col("text")).alias("blank"))
    return rows.mapInArrow(run, "doc long, chunk_index int, vector array<float>, error string")


def save(scanned: DataFrame, current: DataFrame) -> DataFrame:
    """What becomes of encoded documents: saved if the revision is still the scanned one, stale if not, missing if gone."""
    now = current.select(F.col("doc").alias("c_doc"), F.col("revision").alias("c_revision"))
    outcome = F.when(F.col("c_doc").isNull(), "missing").when(F.col("revision").eqNullSafe(F.col("c_revision")), "saved").otherwise("stale")
    return scanned.join(now, F.col("doc") == F.col("c_doc"), "left").withColumn("outcome", outcome).drop("c_doc", "c_revision")


def replace_rows(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """table with the rows of new's keys replaced by new's."""
    return table.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def advance_stamps(stamps: DataFrame, moved: DataFrame) -> DataFrame:
    """Stamps that hold a document's old revision move to its new one: moved(doc, old_revision, new_revision)."""
    m = moved.select(F.col("doc").alias("m_doc"), "old_revision", "new_revision")
    hit = F.col("m_doc").isNotNull() & F.col("revision").eqNullSafe(F.col("old_revision"))
    return stamps.join(m, F.col("doc") == F.col("m_doc"), "left").withColumn("revision", F.when(hit, F.col("new_revision")).otherwise(F.col("revision"))).drop("m_doc", "old_revision", "new_revision")


def upsert_generations(table: DataFrame, new: DataFrame) -> DataFrame:
    """Generations after an upsert by gen_key: state follows the new row, `conflict` where fingerprint or dimension differ."""
    n = new.select("gen_key", *[F.col(c).alias(f"n_{c}") for c in ("fingerprint", "dimension", "state")])
    both = F.col("fingerprint").isNotNull() & F.col("n_fingerprint").isNotNull()
    conflict = both & ((F.col("fingerprint") != F.col("n_fingerprint")) | (F.col("dimension") != F.col("n_dimension")))
    pick = lambda c: F.coalesce(F.col(c), F.col(f"n_{c}")).alias(c)
    state = F.when(conflict, F.col("state")).otherwise(F.coalesce("n_state", "state"))
    return table.join(n, "gen_key", "full_outer").select("gen_key", pick("fingerprint"), pick("dimension"), state.alias("state"), conflict.alias("conflict"))
