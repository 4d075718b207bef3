"""Catalogue queries. Documents are blobs (hash of the text); every 40 consecutive ids are a pack; labelled ones are members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import catalog as C
from corvane.operators import packing
from corvane.plans.registry import query, table

_BLOBS = "blobs AS (SELECT doc_id AS pos, sha256(text) AS hash, CAST(n_chars AS BIGINT) AS size, source FROM documents)"
_ENTRIES = """firsts AS (SELECT hash, min(pos) AS pos, min(size) AS size FROM blobs GROUP BY hash),
entries AS (SELECT hash, pos // 40 AS pack_id, 6 + (pos % 40) * 40000 AS "offset", size AS stored_len, 2 * size AS raw_len, CAST(pos % 2 AS INTEGER) AS flags, pos % 1000 AS crc32c FROM firsts WHERE pos % 5 <> 4)"""
_MEMBERS = "members AS (SELECT DISTINCT sha256(text) AS hash FROM documents JOIN labels USING (doc_id))"
_BASE = f"WITH {_BLOBS}, {_ENTRIES}, {_MEMBERS}"
_PACKS = """packs AS (SELECT pos // 40 AS pack_id, CAST(count(*) AS BIGINT) AS entry_count, CAST(sum(size) AS BIGINT) AS stored_bytes, TIMESTAMP '2024-01-01' + to_days(CAST(pos // 40 AS INTEGER)) AS created_at FROM blobs GROUP BY ALL)"""
_LIVE = "live AS (SELECT * FROM entries WHERE hash IN (SELECT hash FROM members))"
_USAGE = """used AS (SELECT p.*, count(l.hash) AS live, CAST(coalesce(sum(l.stored_len), 0) AS BIGINT) AS live_stored, CAST(coalesce(sum(l.raw_len), 0) AS BIGINT) AS live_raw,
  coalesce(max(l.stored_len), 0) AS max_stored, coalesce(max(l.raw_len), 0) AS max_raw FROM packs p LEFT JOIN live l USING (pack_id) GROUP BY ALL)"""


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("pos"), F.sha2("text", 256).alias("hash"), F.col("n_chars").cast("long").alias("size"), "source")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = blobs(spark, sf_dir).groupBy("hash").agg(F.min("pos").alias("pos"), F.min("size").alias("size")).filter("pos % 5 <> 4")
    return f.select("hash", F.floor(F.col("pos") / 40).alias("pack_id"), (6 + F.col("pos") % 40 * 40000).alias("offset"), F.col("size").alias("stored_len"), (2 * F.col("size")).alias("raw_len"), (F.col("pos") % 2).cast("int").alias("flags"), (F.col("pos") % 1000).alias("crc32c"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return d.select(F.sha2("text", 256).alias("hash")).distinct()


def packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 40).alias("pack_id"), F.col("n_chars").cast("long").alias("size"))
    day = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.col("pack_id").cast("int"))
    return b.groupBy("pack_id").agg(F.count("*").alias("entry_count"), F.sum("size").alias("stored_bytes")).withColumn("created_at", day)


def described(e: DataFrame) -> DataFrame:
    """What containers say of entries: some are lacking or described otherwise."""
    e = e.filter("crc32c % 17 <> 3")
    return e.withColumn("stored_len", F.when(F.col("crc32c") % 19 == 5, F.col("stored_len") + 1).otherwise(F.col("stored_len"))).withColumn("crc32c", F.when(F.col("crc32c") % 23 == 7, F.col("crc32c") + 1).otherwise(F.col("crc32c")))


def footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(entries(spark, sf_dir))


@query(f"WITH {_BLOBS} SELECT hash, min(pos) AS pos, min(size) AS size FROM blobs WHERE hash NOT IN (SELECT hash FROM blobs WHERE pos % 9 = 0) GROUP BY hash")
def blob_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blobs(spark, sf_dir)
    return C.dedup(b.select("hash", "pos", "size"), b.filter("pos % 9 = 0").select("hash").distinct())


@query(f"WITH {_BLOBS} SELECT hash, max(pos) AS index_id, CAST(arg_max(size, pos) AS BIGINT) AS size FROM blobs GROUP BY hash")
def index_union_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.last_index_wins(blobs(spark, sf_dir).select("hash", F.col("pos").alias("index_id"), "size"))


@query(f"{_BASE} SELECT hash, pos FROM blobs WHERE hash IN (SELECT hash FROM members) AND hash NOT IN (SELECT hash FROM entries)")
def list_unpacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.list_unpacked(blobs(spark, sf_dir).select("hash", "pos"), members(spark, sf_dir), entries(spark, sf_dir))


@query(f"{_BASE} SELECT hash, pack_id FROM entries WHERE hash NOT IN (SELECT hash FROM members)")
def prune_unreferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.unreferenced(entries(spark, sf_dir), members(spark, sf_dir)).select("hash", "pack_id")


@query(f"""{_BASE} SELECT b.hash, m.hash IS NOT NULL AS member, CASE WHEN m.hash IS NOT NULL THEN pack_id END AS pack_id, CASE WHEN m.hash IS NOT NULL THEN "offset" END AS "offset"
FROM (SELECT DISTINCT hash FROM blobs) b LEFT JOIN members m USING (hash) LEFT JOIN entries e USING (hash)""")
def resolve_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.resolve(blobs(spark, sf_dir).select("hash").distinct(), members(spark, sf_dir), entries(spark, sf_dir))


@query(f"{_BASE}, {_LIVE} SELECT pack_id, hash, stored_len FROM live")
def live_pack_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.live_entries(entries(spark, sf_dir), members(spark, sf_dir)).select("pack_id", "hash", "stored_len")


@query(f"{_BASE}, {_PACKS}, {_LIVE}, {_USAGE} SELECT pack_id, entry_count, stored_bytes, live, live_stored, live_raw, max_stored, max_raw FROM used")
def pack_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.usage(packs(spark, sf_dir), C.live_entries(entries(spark, sf_dir), members(spark, sf_dir))).drop("created_at")


@query(f"""{_BASE}, {_PACKS}, {_LIVE}, {_USAGE}, later AS (SELECT pack_id, count(*) AS live FROM live WHERE crc32c % 50 <> 0 GROUP BY pack_id)
SELECT pack_id, used.live AS live, coalesce(later.live, 0) AS now_live FROM used LEFT JOIN later USING (pack_id) WHERE used.live <> coalesce(later.live, 0)""")
def usage_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, live = packs(spark, sf_dir), C.live_entries(entries(spark, sf_dir), members(spark, sf_dir))
    return C.usage_changed(C.usage(p, live), C.usage(p, live.filter("crc32c % 50 <> 0"))).select("pack_id", "live", "now_live")


@query(f"""{_BASE}, {_PACKS}, {_LIVE}, {_USAGE} SELECT pack_id, live, live > 0 AS partial FROM used
WHERE live = 0 OR (live <= (entry_count - 1) // 2 AND created_at <= TIMESTAMP '2024-01-15' - INTERVAL 24 HOURS AND stored_bytes - live_stored >= 20000)""")
def repack_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = C.usage(packs(spark, sf_dir), C.live_entries(entries(spark, sf_dir), members(spark, sf_dir)))
    return C.repack_candidates(used, F.lit("2024-01-15").cast("timestamp"), min_dead=20_000).select("pack_id", "live", "partial")


@query(f"""{_BASE} SELECT hash, pack_id AS source, CASE WHEN crc32c % 10 = 1 THEN 'omitted' WHEN crc32c % 10 = 2 THEN 'duplicate' ELSE 'extra' END AS problem
FROM entries WHERE crc32c % 10 IN (1, 2, 3)""")
def repack_cas_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir).select("hash", F.col("pack_id").alias("source"), (F.col("crc32c") % 10).alias("k"))
    moves = e.filter("k <> 1").select("hash", "source", F.explode(F.when(F.col("k") == 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("i"))
    return C.moves_problems(e.filter("k <> 3").select("hash", "source"), moves.select("hash", "source"))


@query(f"""WITH {_BLOBS}, p AS (SELECT hash, source AS path, min(pos) AS seen FROM blobs GROUP BY hash, source)
SELECT hash, min(pos) AS first_pos, (SELECT string_agg(path, ',' ORDER BY seen) FROM p WHERE p.hash = b.hash) AS paths, min(size + pos % 2) <> max(size + pos % 2) AS conflict FROM blobs b GROUP BY hash""")
def candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blobs(spark, sf_dir).select("hash", "pos", F.array("source").alias("paths"), F.array("hash").alias("original_hashes"), (F.col("size") + F.col("pos") % 2).alias("size"))
    return C.merge_candidates(rows).select("hash", "first_pos", F.array_join("paths", ",").alias("paths"), "conflict")


@query(f"""{_BASE}, {_PACKS} SELECT 'record' AS kind, pack_id, NULL::VARCHAR AS hash FROM packs WHERE pack_id % 4 = 1
UNION ALL SELECT 'entry', pack_id, hash FROM entries WHERE pack_id % 4 = 1""")
def dangling_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packs(spark, sf_dir)
    return C.dangling(p, entries(spark, sf_dir), p.filter("pack_id % 4 <> 1"))


@query(f"""{_BASE} SELECT hash, pack_id FROM entries WHERE pack_id % 4 = 1 AND hash IN (SELECT hash FROM members) AND hash IN (SELECT hash FROM blobs WHERE pos % 3 = 0)""")
def dangling_recoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    loose = blobs(spark, sf_dir).select("hash", (F.col("pos") % 3 == 0).alias("valid"))
    return C.recoveries(entries(spark, sf_dir).filter("pack_id % 4 = 1"), loose, members(spark, sf_dir)).select("hash", "pack_id")


@query(f"""{_BASE} SELECT pack_id, count(*) AS entries, count(*) FILTER (hash IN (SELECT hash FROM members) AND crc32c % 3 <> 0) AS adopted, count(*) FILTER (hash IN (SELECT hash FROM members) AND crc32c % 3 <> 0) = 0 AS remove_pack
FROM entries WHERE pack_id % 3 = 2 GROUP BY pack_id""")
def orphan_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    return C.orphan_adoptions(e, packs(spark, sf_dir).filter("pack_id % 3 <> 2"), members(spark, sf_dir), e.filter("crc32c % 3 = 0"))


def _sweep_sql(orphan: str) -> str:
    return f"""{_BASE} SELECT DISTINCT b.hash, CASE WHEN e.hash IS NOT NULL THEN 'remove' WHEN m.hash IS NULL THEN '{orphan}' ELSE 'keep' END AS action
FROM blobs b LEFT JOIN entries e USING (hash) LEFT JOIN members m USING (hash)"""


@query(_sweep_sql("orphan"))
def loose_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sweep_loose(blobs(spark, sf_dir).select("hash").distinct(), entries(spark, sf_dir), members(spark, sf_dir), True)


@query(_sweep_sql("keep"))
def loose_sweep_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sweep_loose(blobs(spark, sf_dir).select("hash").distinct(), entries(spark, sf_dir), members(spark, sf_dir), False)


@query(f"""{_BASE} SELECT pack_id, hash, CASE WHEN crc32c % 17 = 3 THEN 'missing' WHEN crc32c % 19 = 5 THEN 'stored_len' ELSE 'crc32c' END AS problem
FROM entries WHERE crc32c % 17 = 3 OR crc32c % 19 = 5 OR crc32c % 23 = 7""")
def footer_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.footer_mismatches(entries(spark, sf_dir), footers(spark, sf_dir))


@query(f"""{_BASE}, near AS (SELECT pack_id, hash, "offset" // 20 AS o, stored_len AS s FROM entries WHERE stored_len > 0),
r AS (SELECT *, max(o + s) OVER (PARTITION BY pack_id ORDER BY o, o + s, hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM near)
SELECT pack_id, hash, o AS "offset", reach FROM r WHERE o < reach""")
def span_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.overlaps(entries(spark, sf_dir).withColumn("offset", F.floor(F.col("offset") / 20)))


@query(f"""WITH {_BLOBS}, paths AS (SELECT CASE pos % 5 WHEN 0 THEN substring(hash, 1, 2) || '/' || hash WHEN 1 THEN 'loose/' || substring(hash, 1, 2) || '/' || hash || '.zst'
    WHEN 2 THEN 'packs/01/01hzy3v9k' || lpad(CAST(pos AS VARCHAR), 17, '0') || '.mvpack' WHEN 3 THEN 'xx/' || hash ELSE 'tmp/' || pos END AS path, pos, hash FROM blobs)
SELECT path, CASE pos % 5 WHEN 0 THEN 'loose raw' WHEN 1 THEN 'loose zstd' WHEN 2 THEN 'pack' ELSE 'unknown' END AS kind,
  CASE pos % 5 WHEN 0 THEN 'loose/raw/' || hash WHEN 1 THEN 'loose/zstd/' || hash WHEN 2 THEN 'pack/01hzy3v9k' || lpad(CAST(pos AS VARCHAR), 17, '0') ELSE 'unknown/' || path END AS ref_key FROM paths""")
def inventory_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, p, k = F.col("hash"), F.col("pos").cast("string"), F.col("pos") % 5
    path = (
        F.when(k == 0, F.concat(F.left(h, F.lit(2)), F.lit("/"), h)).when(k == 1, F.concat(F.lit("loose/"), F.left(h, F.lit(2)), F.lit("/"), h, F.lit(".zst")))
        .when(k == 2, F.concat(F.lit("packs/01/01hzy3v9k"), F.lpad(p, 17, "0"), F.lit(".mvpack"))).when(k == 3, F.concat(F.lit("xx/"), h)).otherwise(F.concat(F.lit("tmp/"), p))
    )
    return C.classify_objects(blobs(spark, sf_dir).select(path.alias("path")))


@query("""WITH c AS (SELECT l_orderkey AS hash, l_linenumber AS cand_pos, l_returnflag = 'R' AS store_failed, l_linestatus = 'F' AS location_failed FROM lineitem)
SELECT hash, cand_pos, CAST(store_failed AS INTEGER) + 2 * CAST(location_failed AS INTEGER) AS health,
  row_number() OVER (PARTITION BY hash ORDER BY CAST(store_failed AS INTEGER) + 2 * CAST(location_failed AS INTEGER), cand_pos) - 1 AS attempt FROM c""")
def candidate_health_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hash"), F.col("l_linenumber").alias("cand_pos"), (F.col("l_returnflag") == "R").alias("store_failed"), (F.col("l_linestatus") == "F").alias("location_failed"))
    return C.health_order(c).select("hash", "cand_pos", "health", F.col("attempt").cast("long").alias("attempt"))


_KINDS = "CASE l_partkey % 4 WHEN 0 THEN 'corrupt' WHEN 1 THEN 'missing' WHEN 2 THEN 'fenced' ELSE 'unavailable' END"


@query(f"""WITH f AS (SELECT l_orderkey AS hash, l_linenumber AS p, {_KINDS} AS kind, 4 - l_partkey % 4 AS r FROM lineitem)
SELECT hash, arg_max(kind, r) AS kind, count(*) AS tried FROM f GROUP BY hash""")
def exhausted_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.headline(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hash"), F.col("l_linenumber").alias("cand_pos"), F.expr(_KINDS).alias("kind")))


@query("""WITH c AS (SELECT p_partkey, p_partkey * 977 % 150000 AS n, p_size * 3500000 AS b FROM part)
SELECT p_partkey, CASE WHEN n > 100000 THEN 'entries' WHEN 4 + 61 * n > 8388608 THEN 'footer' WHEN b + 4 + 61 * n + 40 > 134217728 THEN 'container' END AS problem FROM c""")
def limit_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, b = F.col("p_partkey") * 977 % 150_000, F.col("p_size").cast("long") * 3_500_000
    return table(spark, sf_dir, "part").select("p_partkey", C.limit_problem(n, b).alias("problem"))


@query("""WITH e AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'XYZ' ELSE sha256(p_name) END AS hash, CASE p_partkey % 8 WHEN 1 THEN 5 ELSE 6 END AS o, CASE p_partkey % 8 WHEN 2 THEN -1 WHEN 3 THEN 99999999 ELSE 10 END AS s,
  CASE p_partkey % 8 WHEN 4 THEN 4294967297 ELSE 10 END AS r, CASE p_partkey % 8 WHEN 5 THEN 2 ELSE 0 END AS f, CASE p_partkey % 8 WHEN 6 THEN 4294967296 ELSE 7 END AS c FROM part)
SELECT p_partkey, CASE WHEN NOT regexp_full_match(hash, '[0-9a-f]{64}') THEN 'hash' WHEN s < 0 OR r < 0 THEN 'negative' WHEN o < 6 THEN 'offset' WHEN f NOT IN (0, 1) THEN 'flags' WHEN s > 67108864 THEN 'stored' WHEN r > 4294967296 THEN 'raw' WHEN c >= 4294967296 THEN 'crc32c' END AS problem FROM e""")
def entry_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 8
    pick = lambda n, v, d: F.when(k == n, v).otherwise(d).cast("long")
    e = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(k == 0, "XYZ").otherwise(F.sha2("p_name", 256)).alias("hash"), pick(1, 5, 6).alias("offset"), F.when(k == 2, -1).when(k == 3, 99_999_999).otherwise(10).cast("long").alias("stored_len"),
        pick(4, 4294967297, 10).alias("raw_len"), pick(5, 2, 0).alias("flags"), pick(6, 4294967296, 7).alias("crc32c"),
    )
    return e.select("p_partkey", C.entry_problem().alias("problem"))


@query(f"WITH {_BLOBS} SELECT pos // 400 AS pack_id, hash, count(*) AS n FROM blobs GROUP BY ALL HAVING count(*) > 1")
def duplicate_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.duplicates(blobs(spark, sf_dir).select(F.floor(F.col("pos") / 400).alias("pack_id"), "hash"))


@query("""WITH RECURSIVE b AS (SELECT doc_id // 200 AS grp, doc_id AS pos, CAST(n_chars AS BIGINT) AS n, row_number() OVER (PARTITION BY doc_id // 200 ORDER BY doc_id) AS k FROM documents),
f AS (SELECT grp, pos, n, k, 0 AS pack, n AS written, 1 AS held FROM b WHERE k = 1
  UNION ALL SELECT b.grp, b.pos, b.n, b.k, CASE WHEN written >= 20000 OR held >= 12 THEN pack + 1 ELSE pack END, CASE WHEN written >= 20000 OR held >= 12 THEN b.n ELSE written + b.n END, CASE WHEN written >= 20000 OR held >= 12 THEN 1 ELSE held + 1 END
  FROM f JOIN b ON b.grp = f.grp AND b.k = f.k + 1)
SELECT grp, pos, n AS stored_len, CAST(pack AS BIGINT) AS pack FROM f""")
def pack_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return packing.rotate(d.select(F.floor(F.col("doc_id") / 200).alias("grp"), F.col("doc_id").alias("pos"), F.col("n_chars").cast("long").alias("stored_len")), 20_000, 12)


@query("""WITH c AS (SELECT source AS grp, doc_id AS pos, CAST(n_chars AS BIGINT) AS raw_len, CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM documents)
SELECT * FROM c WHERE before < 30000""")
def budget_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("grp"), F.col("doc_id").alias("pos"), F.col("n_chars").cast("long").alias("raw_len"))
    return C.budget(d, 30_000, ["grp"])
