"""Retrieval queries. Vectors stand for chunks: document vec_id % 50, chunk vec_id div 50; even ids are the building generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import scalars, text, vectors
from corvane.operators import retrieval as R
from corvane.plans.registry import query, table

K = 20
_SCORE = "CAST(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS FLOAT)"
_DOCS = """docs AS (SELECT DISTINCT vec_id % 50 AS doc, CASE WHEN vec_id % 50 % 11 = 0 THEN NULL ELSE 1 END AS embed_gen, vec_id % 50 % 7 AS revision FROM embeddings),
stamps AS (SELECT doc, CASE WHEN doc % 3 = 0 THEN revision + 1 ELSE revision END AS revision FROM docs WHERE doc % 5 <> 0),
marked AS (SELECT d.*, embed_gen IS NOT NULL AND s.doc IS NOT NULL AND d.revision IS NOT DISTINCT FROM s.revision AS is_covered FROM docs d LEFT JOIN stamps s USING (doc))"""
_LISTS = f"""q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
scored AS (SELECT vec_id % 2 AS gen_pos, vec_id % 50 // 2 AS doc, vec_id // 50 AS chunk_index, vec_id, {_SCORE} AS score FROM embeddings e, q),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gen_pos ORDER BY score DESC, vec_id) - 1 AS pos FROM scored) WHERE pos < {K}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gen_pos, doc ORDER BY score DESC, pos) AS k, min(pos) OVER (PARTITION BY gen_pos, doc) AS first_pos FROM hits) WHERE k = 1),
rolled AS (SELECT gen_pos, doc, chunk_index, score, row_number() OVER (PARTITION BY gen_pos ORDER BY score DESC, first_pos) - 1 AS rank FROM best)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("vec_id") % 50).alias("doc"), F.floor(F.col("vec_id") / 50).alias("chunk_index"))


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()[0])


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).alias("doc")).distinct()
    return d.select("doc", F.when(F.col("doc") % 11 != 0, 1).alias("embed_gen"), (F.col("doc") % 7).alias("revision"))


def _stamps(docs: DataFrame) -> DataFrame:
    return docs.filter("doc % 5 <> 0").select(F.lit(1).alias("ordinal"), "doc", (F.col("revision") + F.when(F.col("doc") % 3 == 0, 1).otherwise(0)).alias("revision"))


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranked lists, the top K of each generation, with positions."""
    from pyspark.sql import Window

    q, v = _query_vector(spark, sf_dir), _vectors(spark, sf_dir).withColumn("doc", F.floor(F.col("doc") / 2))
    tops = [R.nearest(v.filter(F.col("vec_id") % 2 == g), q, K).select(F.lit(g).cast("long").alias("gen_pos"), "*") for g in (0, 1)]
    return tops[0].unionByName(tops[1]).withColumn("pos", F.row_number().over(Window.partitionBy("gen_pos").orderBy(F.desc("score"), "vec_id")) - 1)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("doc", "chunk_index", F.round(F.col("score").cast("double"), 5).alias("score"))


@query(f"SELECT e.vec_id, e.label, round(CAST({_SCORE} AS DOUBLE), 5) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY {_SCORE} DESC, e.vec_id LIMIT 10")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = R.nearest(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10)
    return top.select("vec_id", "label", F.round(F.col("score").cast("double"), 5).alias("score"))


@query(f"""WITH {_DOCS}, q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
top AS (SELECT vec_id, vec_id % 50 AS doc, vec_id // 50 AS chunk_index, {_SCORE} AS score FROM embeddings e, q ORDER BY score DESC, vec_id LIMIT 40)
SELECT vec_id, doc, chunk_index, round(CAST(score AS DOUBLE), 5) AS score FROM top JOIN marked USING (doc) WHERE is_covered""")
def knn_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    out = R.nearest_covered(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 40, docs, _stamps(docs), 1)
    return out.withColumn("score", F.round(F.col("score").cast("double"), 5))


@query(f"WITH {_LISTS} SELECT gen_pos, doc, chunk_index, round(CAST(score AS DOUBLE), 5) AS score, rank FROM rolled")
def rollup_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.rollup_by_document(_lists(spark, sf_dir))
    return out.select("gen_pos", "doc", "chunk_index", F.round(F.col("score").cast("double"), 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def _merge_sql(value: str, pick: str) -> str:
    return f"""WITH {_LISTS}, valued AS (SELECT *, {value} AS value FROM rolled),
firsts AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY gen_pos, rank) AS k, sum(value) OVER (PARTITION BY doc) AS total FROM valued)
SELECT doc, chunk_index, round(CAST(CAST({pick} AS FLOAT) AS DOUBLE), 5) AS score FROM firsts WHERE k = 1 ORDER BY CAST({pick} AS FLOAT) DESC, gen_pos, rank LIMIT 12"""


@query(_merge_sql("CAST(score AS DOUBLE)", "value"))
def merge_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(R.merge(R.rollup_by_document(_lists(spark, sf_dir)), "raw", 12))


_LO, _HI = "min(score) OVER (PARTITION BY gen_pos)", "max(score) OVER (PARTITION BY gen_pos)"


@query(_merge_sql(f"CASE WHEN {_HI} - {_LO} > 0 THEN CAST(score - {_LO} AS DOUBLE) / CAST({_HI} - {_LO} AS DOUBLE) ELSE 1.0 END", "value"))
def merge_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(R.merge(R.rollup_by_document(_lists(spark, sf_dir)), "normalized", 12))


@query(_merge_sql("1.0::DOUBLE / (60 + rank + 1)", "total"))
def merge_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(R.merge(R.rollup_by_document(_lists(spark, sf_dir)), "rrf", 12))


@query(f"""WITH {_LISTS}, {_DOCS}, alive AS (SELECT gen_pos, doc, chunk_index, score, pos FROM hits JOIN marked USING (doc) WHERE is_covered),
best2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gen_pos, doc ORDER BY score DESC, pos) AS k, min(pos) OVER (PARTITION BY gen_pos, doc) AS first_pos FROM alive) WHERE k = 1),
rolled2 AS (SELECT *, row_number() OVER (PARTITION BY gen_pos ORDER BY score DESC, first_pos) - 1 AS rank FROM best2),
firsts AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY gen_pos, rank) AS n FROM rolled2)
SELECT doc, chunk_index, round(CAST(score AS DOUBLE), 5) AS score FROM firsts WHERE n = 1""")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live generations, top K of each, current documents, roll-up, union."""
    docs = _docs(spark, sf_dir)
    alive = R.with_stamps(docs, _stamps(docs), 1).filter("is_covered").select("doc")
    hits = _lists(spark, sf_dir)
    return _shown(R.merge(R.rollup_by_document(hits.join(alive, "doc")), "raw"))


_PENDING = """WITH docs AS (SELECT doc_id AS doc, text AS content, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 1 END AS embed_gen, doc_id % 7 AS revision FROM documents),
stamps AS (SELECT doc, CASE WHEN doc % 3 = 0 THEN revision + 1 ELSE revision END AS revision FROM docs WHERE doc % 5 <> 0),
marked AS (SELECT d.*, embed_gen IS NOT NULL AND s.doc IS NOT NULL AND d.revision IS NOT DISTINCT FROM s.revision AS is_covered FROM docs d LEFT JOIN stamps s USING (doc))"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("content"), F.when(F.col("doc_id") % 11 != 0, 1).alias("embed_gen"), (F.col("doc_id") % 7).alias("revision"))


@query(_PENDING + " SELECT doc, revision, CAST(length(coalesce(content, '')) AS INTEGER) AS n FROM marked WHERE NOT is_covered")
def pending_for_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    return R.pending(docs, _stamps(docs), 1).select("doc", "revision", F.char_length("content").alias("n"))


@query(_PENDING + " SELECT doc FROM marked WHERE NOT is_covered ORDER BY doc LIMIT 25")
def pending_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    return R.pending(docs, _stamps(docs), 1, 25).select("doc")


@query(_PENDING + """, gens AS (SELECT * FROM (VALUES (1, 1), (2, 2)) g(gen_key, ordinal))
SELECT m.doc, g.ordinal IS NOT NULL AND is_covered AS current FROM marked m LEFT JOIN gens g ON g.gen_key = m.embed_gen""")
def doc_invalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    gens = F.broadcast(spark.createDataFrame([(1, 1), (2, 2)], "gen_key int, ordinal int"))
    marked = R.with_stamps(docs, _stamps(docs), 1)
    return marked.join(gens, F.col("embed_gen") == F.col("gen_key"), "left").select("doc", (F.col("ordinal").isNotNull() & F.col("is_covered")).alias("current"))


_GENS = "(VALUES (1, 'a', 'retired'), (2, 'b', 'active'), (3, 'c', 'building'), (4, 'd', 'pending'), (5, 'e', 'active')) g(ordinal, gen_key, state)"


@query(f"SELECT ordinal, gen_key, row_number() OVER (ORDER BY CASE state WHEN 'building' THEN 0 ELSE 1 END, ordinal) - 1 AS gen_pos FROM {_GENS} WHERE state IN ('building', 'active')")
def live_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    gens = spark.createDataFrame([(1, "a", "retired"), (2, "b", "active"), (3, "c", "building"), (4, "d", "pending"), (5, "e", "active")], "ordinal int, gen_key string, state string")
    return R.live_generations(gens).select("ordinal", "gen_key", F.col("gen_pos").cast("long").alias("gen_pos"))


@query("""WITH v AS (SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN list_transform(embedding, lambda x: x * 0) WHEN 1 THEN embedding[1:63] WHEN 2 THEN list_concat(embedding[1:3], ['nan'::FLOAT], embedding[5:64]) ELSE embedding END AS e FROM embeddings)
SELECT vec_id, CASE WHEN len(e) <> 64 THEN 'dimension ' || len(e) WHEN vec_id % 5 = 2 THEN 'component 3' WHEN len(list_filter(e, lambda x: x <> 0)) = 0 THEN 'zero norm' END AS problem FROM v""")
def vector_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = F.col("embedding"), F.col("vec_id") % 5
    broken = F.when(k == 0, F.transform(e, lambda x: x * F.lit(0).cast("float"))).when(k == 1, F.slice(e, 1, 63)).when(k == 2, F.concat(F.slice(e, 1, 3), F.array(F.lit(float("nan")).cast("float")), F.slice(e, 5, 60))).otherwise(e)
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.problem(broken, 64).alias("problem"))


_SPLIT = r"""SELECT doc_id AS doc, i AS chunk_index, substring(text, i * 450 + 1, 500) AS text
FROM (SELECT doc_id, text, unnest(range(CASE WHEN length(text) <= 500 THEN 1 ELSE CAST(ceil((length(text) - 500) / 450.0) AS BIGINT) + 1 END)) AS i FROM documents)
WHERE NOT regexp_full_match(substring(text, i * 450 + 1, 500), '[\s\x00-\x1f\x7f]*')"""


@query(f"SELECT doc, CAST(chunk_index AS INTEGER) AS chunk_index, sha256(text) AS chunk_hash FROM ({_SPLIT})")
def split_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.chunks(_texts(spark, sf_dir), 500, 50).select("doc", "chunk_index", F.sha2("text", 256).alias("chunk_hash"))


@query(r"SELECT conv_id, turn, regexp_full_match(coalesce(CASE turn % 3 WHEN 0 THEN ' ' || chr(8203) || chr(9) WHEN 1 THEN chr(10240) ELSE text END, ''), '[\s\p{Z}\p{Cc}\p{Cf}]*') AS blank FROM conversations")
def blank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    t = F.when(F.col("turn") % 3 == 0, " \u200b\t").when(F.col("turn") % 3 == 1, "\u2800").otherwise(F.col("text"))
    return c.select("conv_id", "turn", text.blank(t).alias("blank"))


@query(f"""WITH c AS ({_SPLIT}), n AS (SELECT doc, count(*) AS chunks FROM c GROUP BY doc)
SELECT count(*) FILTER (chunks > 0 AND doc_id % 13 <> 0) AS documents, CAST(coalesce(sum(chunks) FILTER (doc_id % 13 <> 0), 0) AS BIGINT) AS chunks, count(*) FILTER (chunks IS NULL) AS skipped, count(*) FILTER (doc_id % 13 = 0) AS stale
FROM documents LEFT JOIN n ON doc = doc_id""")
def fill_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fill: split, save with the revision check (every 13th document was edited meanwhile), count."""
    docs = _texts(spark, sf_dir)
    n = F.size(text.split_chunks(F.col("content"), 500, 50))
    scanned = docs.select("doc", "revision", n.alias("n"))
    current = docs.select("doc", (F.col("revision") + F.when(F.col("doc") % 13 == 0, 1).otherwise(0)).alias("revision"))
    out = R.save(scanned, current)
    saved = F.col("outcome") == "saved"
    return out.agg(F.count_if(saved & (F.col("n") > 0)).alias("documents"), F.coalesce(F.sum(F.when(saved, F.col("n")).cast("long")), F.lit(0)).alias("chunks"), F.count_if(F.col("n") == 0).alias("skipped"), F.count_if(F.col("outcome") == "stale").alias("stale"))


@query(f"""SELECT doc, CAST(chunk_index AS INTEGER) AS chunk_index, CASE WHEN contains(lower(text), 'the') THEN 'the' WHEN contains(lower(text), 'der') THEN 'der' ELSE 'other' END AS topic FROM ({_SPLIT})""")
def fill_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.chunks(_texts(spark, sf_dir), 500, 50)
    v = R.topic_encoder(F.col("text"), ["the", "der"])
    return c.select("doc", "chunk_index", F.element_at(F.array(F.lit("the"), F.lit("der"), F.lit("other")), F.array_position(v, 1.0).cast("int")).alias("topic"))


@query(f"""WITH c AS (SELECT doc, chunk_index, row_number() OVER (ORDER BY doc, chunk_index) - 1 AS k FROM ({_SPLIT}))
SELECT k // 32 AS batch, doc, CAST(min(chunk_index) AS INTEGER) AS first_chunk, count(*) AS n_chunks FROM c GROUP BY ALL""")
def encode_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.encode_batches(R.chunks(_texts(spark, sf_dir), 500, 50), 32)


@query("""SELECT conv_id, turn, sha256(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(10), ' '), '\t', ' ', 'g')) AS line_hash FROM conversations""")
def sanitize_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    dressed = F.concat(F.lit("\x1b[31m"), F.col("text"), F.lit("\x1b[0m\x1b]0;title\x07\u200b"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(text.sanitize_line(dressed), 256).alias("line_hash"))


@query("""SELECT p_partkey, substring(sha256('{"dimensions":' || p_size || ',"model":"' || p_brand || '","params":{"a":"' || p_type || '","b":"\\u003cx\\u0026"}}'), 1, 16) AS fingerprint FROM part""")
def generation_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = F.create_map(F.lit("b"), F.lit("<x&"), F.lit("a"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.fingerprint(F.col("p_brand"), F.col("p_size"), params).alias("fingerprint"))


@query("""WITH s AS (SELECT doc_id AS doc, g AS ordinal, CASE WHEN g = 2 AND doc_id % 4 = 0 THEN NULL ELSE doc_id % 7 END AS revision FROM documents, (VALUES (1), (2)) t(g))
SELECT ordinal, doc, CASE WHEN doc % 2 = 0 AND revision IS NOT DISTINCT FROM doc % 7 THEN doc % 7 + 100 ELSE revision END AS revision FROM s""")
def stamp_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.explode(F.array(F.lit(1), F.lit(2))).alias("ordinal"))
    stamps = d.select("ordinal", "doc", F.when(~((F.col("ordinal") == 2) & (F.col("doc") % 4 == 0)), F.col("doc") % 7).alias("revision"))
    moved = d.filter("ordinal = 1 and doc % 2 = 0").select("doc", (F.col("doc") % 7).alias("old_revision"), (F.col("doc") % 7 + 100).alias("new_revision"))
    return R.advance_stamps(stamps, moved).select("ordinal", "doc", "revision")


@query("""SELECT doc_id AS doc, 0 AS chunk_index, CASE WHEN doc_id % 6 = 0 THEN 'new' ELSE 'old' END AS v FROM documents
UNION ALL SELECT doc_id, 1, 'old' FROM documents WHERE doc_id % 6 <> 0""")
def save_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"))
    old = d.select("doc", F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_index"), F.lit("old").alias("v"))
    return R.replace_rows(old, d.filter("doc % 6 = 0").select("doc", F.lit(0).alias("chunk_index"), F.lit("new").alias("v")), ["doc"])


@query("""WITH t AS (SELECT 'g' || p_partkey AS gen_key, p_brand AS fingerprint, p_size AS dimension, 'active' AS state FROM part WHERE p_partkey % 3 <> 0),
n AS (SELECT 'g' || p_partkey AS gen_key, CASE WHEN p_partkey % 10 = 0 THEN 'other' ELSE p_brand END AS fingerprint, p_size AS dimension, 'building' AS state FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(t.gen_key, n.gen_key) AS gen_key, coalesce(t.fingerprint, n.fingerprint) AS fingerprint, coalesce(t.dimension, n.dimension) AS dimension,
  CASE WHEN t.fingerprint <> n.fingerprint OR t.dimension <> n.dimension THEN t.state ELSE coalesce(n.state, t.state) END AS state,
  coalesce(t.fingerprint <> n.fingerprint OR t.dimension <> n.dimension, false) AS conflict FROM t FULL JOIN n ON t.gen_key = n.gen_key""")
def generation_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    row = lambda f, s: (F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("gen_key"), f.alias("fingerprint"), F.col("p_size").alias("dimension"), F.lit(s).alias("state"))
    t = p.filter("p_partkey % 3 <> 0").select(*row(F.col("p_brand"), "active"))
    n = p.filter("p_partkey % 2 = 0").select(*row(F.when(F.col("p_partkey") % 10 == 0, "other").otherwise(F.col("p_brand")), "building"))
    return R.upsert_generations(t, n)
