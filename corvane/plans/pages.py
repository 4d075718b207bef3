"""Page and snapshot queries. Orders are pages by key; the parent snapshot lacks some, has others changed and is longer or shorter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import packing
from corvane.operators import pages as P
from corvane.operators import snapshots as S
from corvane.plans.registry import query, table

_HASH = "substring(sha256(o_orderpriority || o_orderkey), 1, 32)"
#: The parent has 14 of every 15 pages; a delta cuts to 13 of them.
_COUNT, _CUT = "(SELECT max(o_orderkey) * 14 // 15 FROM orders)", "(SELECT max(o_orderkey) * 13 // 15 FROM orders)"
_PAGES = f"""pages_ AS (SELECT o_orderkey - 1 AS page, {_HASH} AS hash FROM orders),
parent AS (SELECT page, CASE WHEN page % 97 < 5 THEN 'changed' ELSE hash END AS hash FROM pages_ WHERE page % 211 <> 7 AND page < {_COUNT}),
dirty AS (SELECT p.page, p.hash FROM pages_ p LEFT JOIN parent q USING (page) WHERE q.hash IS NULL OR p.page >= {_COUNT} OR p.hash <> q.hash)"""
_RUNS = """isles AS (SELECT page, page - row_number() OVER (ORDER BY page) AS g FROM dirty), runs AS (SELECT min(page) AS start, count(*) AS "count" FROM isles GROUP BY g)"""


def largest(spark: SparkSession, sf_dir: str, column: str = "o_orderkey") -> int:
    return table(spark, sf_dir, "orders").agg(F.max(column)).first()[0] or 0


def parent_count(spark: SparkSession, sf_dir: str) -> int:
    return largest(spark, sf_dir) * 14 // 15


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") - 1).alias("page"), P.page_hash(F.concat("o_orderpriority", F.col("o_orderkey").cast("string"))).alias("hash"))


def parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).filter(f"page % 211 <> 7 and page < {parent_count(spark, sf_dir)}").withColumn("hash", F.when(F.col("page") % 97 < 5, "changed").otherwise(F.col("hash")))


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.dirty(pages(spark, sf_dir), parent(spark, sf_dir), parent_count(spark, sf_dir))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.runs_of(dirty(spark, sf_dir))


@query(f"WITH {_PAGES} SELECT page, hash FROM pages_")
def page_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir)


@query(f"WITH {_PAGES} SELECT page, hash FROM dirty")
def dirty_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty(spark, sf_dir)


@query(f'WITH {_PAGES}, {_RUNS} SELECT start, "count" FROM runs')
def dirty_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir)


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of customers in groups of nations, some of them large."""
    c = table(spark, sf_dir, "customer")
    count = F.when(F.col("c_custkey") % 50 == 0, 3000).when(F.col("c_custkey") % 20 == 0, 256).otherwise(1 + F.col("c_custkey") * 7 % 200).cast("long")
    return packing.plan_blobs(c.select(F.col("c_nationkey").cast("long").alias("grp"), (F.col("c_custkey") * 5000).alias("start"), count.alias("count")))


_PLAN = """c AS (SELECT CAST(c_nationkey AS BIGINT) AS grp, c_custkey * 5000 AS start, CAST(CASE WHEN c_custkey % 50 = 0 THEN 3000 WHEN c_custkey % 20 = 0 THEN 256 ELSE 1 + c_custkey * 7 % 200 END AS BIGINT) AS n,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer),
f AS (SELECT grp, start, n, k, CAST(0 AS BIGINT) AS plan, CASE WHEN n >= 256 THEN 0 ELSE n END AS held, CASE WHEN n >= 256 THEN (n + 1023) // 1024 ELSE 0 END AS next FROM c WHERE k = 1
  UNION ALL SELECT c.grp, c.start, c.n, c.k, CAST(s.p AS BIGINT), CASE WHEN c.n >= 256 THEN 0 WHEN f.held > 0 AND f.held + c.n <= 1024 THEN f.held + c.n ELSE c.n END, CASE WHEN c.n >= 256 THEN s.p + (c.n + 1023) // 1024 ELSE s.p END
  FROM f JOIN c ON c.grp = f.grp AND c.k = f.k + 1, LATERAL (SELECT CASE WHEN c.n >= 256 THEN f.next + CAST(f.held > 0 AS INTEGER) WHEN f.held > 0 AND f.held + c.n > 1024 THEN f.next + 1 ELSE f.next END AS p) s),
plans AS (SELECT grp, plan + i AS plan, start + i * 1024 AS start, least(1024, n - i * 1024) AS "count" FROM (SELECT *, unnest(range(CASE WHEN n >= 256 THEN (n + 1023) // 1024 ELSE 1 END)) AS i FROM f))"""


@query(f'WITH RECURSIVE {_PLAN} SELECT grp, plan, start, "count" FROM plans')
def blob_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


@query(f"""WITH RECURSIVE {_PLAN} SELECT grp * 100000 + plan AS plan, start, "count", CAST(coalesce(sum("count") OVER (PARTITION BY grp, plan ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 4096 AS BIGINT) AS blob_offset FROM plans""")
def run_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _plan(spark, sf_dir).select((F.col("grp") * 100_000 + F.col("plan")).alias("plan"), "start", "count")
    return P.run_offsets(p, 4096)


@query(f"WITH {_PAGES} SELECT coalesce(d.page, p.page) AS page, coalesce(d.hash, p.hash) AS hash FROM parent p FULL JOIN dirty d USING (page) WHERE coalesce(d.page, p.page) < {_CUT}")
def apply_hash_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.apply_hashes(parent(spark, sf_dir), dirty(spark, sf_dir), largest(spark, sf_dir) * 13 // 15)


@query(f"""SELECT page FROM (SELECT unnest(range({_COUNT}, (SELECT max(o_orderkey) FROM orders))) AS page) WHERE page NOT IN (SELECT o_orderkey - 1 FROM orders WHERE o_orderkey % 3 <> 0)""")
def growth_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.growth_gaps(parent_count(spark, sf_dir), pages(spark, sf_dir).filter("(page + 1) % 3 <> 0"), largest(spark, sf_dir))


def _maps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Base runs of 50 pages each, and delta runs over some of them."""
    o = table(spark, sf_dir, "orders").filter("o_orderkey > 0").select((F.col("o_orderkey") - 1).alias("k"))  # pages begin at 0
    base = o.select((F.col("k") * 50).alias("start_page"), F.lit(50).cast("long").alias("page_count"), F.concat(F.lit("b"), F.floor(F.col("k") / 4)).alias("blob"), (F.col("k") % 4 * 50).alias("blob_offset"))
    delta = o.filter("k % 6 = 1").select((F.col("k") * 50 + 30).alias("start_page"), F.lit(35).cast("long").alias("page_count"), F.lit("d").alias("blob"), (F.col("k") * 35).alias("blob_offset"))
    return base, delta


_MAPS = """base AS (SELECT k * 50 AS s, 50 AS n, 'b' || (k // 4) AS blob, k % 4 * 50 AS o FROM (SELECT o_orderkey - 1 AS k FROM orders WHERE o_orderkey > 0)),
delta AS (SELECT k * 50 + 30 AS s, 35 AS n, 'd' AS blob, k * 35 AS o FROM (SELECT o_orderkey - 1 AS k FROM orders WHERE o_orderkey > 0) WHERE k % 6 = 1),
pts AS (SELECT 0 AS tag, s, blob, o + i AS place, s + i AS page FROM (SELECT *, unnest(range(n)) AS i FROM base) UNION ALL SELECT 1, s, blob, o + i, s + i FROM (SELECT *, unnest(range(n)) AS i FROM delta)),
own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY tag DESC) AS r FROM pts WHERE page < (SELECT max(o_orderkey) * 45 FROM orders)) WHERE r = 1)"""


@query(f"""WITH {_MAPS}, g AS (SELECT *, page - row_number() OVER (PARTITION BY tag, s, blob ORDER BY page) AS g FROM own)
SELECT min(page) AS start_page, count(*) AS page_count, blob, min(place) AS blob_offset FROM g GROUP BY tag, s, blob, g""")
def apply_page_map_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, delta = _maps(spark, sf_dir)
    return P.apply_runs(base, delta, largest(spark, sf_dir) * 45)


@query(f"""WITH {_MAPS}, kept AS (SELECT s, n FROM base WHERE s % 350 <> 100), l AS (SELECT coalesce(lag(s + n) OVER (ORDER BY s), 0) AS expected, s AS found FROM kept UNION ALL SELECT max(s + n), (SELECT max(o_orderkey) * 50 + 1000 FROM orders) FROM kept)
SELECT CAST(expected AS BIGINT) AS expected, CAST(found AS BIGINT) AS found FROM l WHERE expected <> found""")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.coverage_gaps(_maps(spark, sf_dir)[0].filter("start_page % 350 <> 100"), largest(spark, sf_dir) * 50 + 1000)


@query(f"WITH {_MAPS} SELECT o_orderkey - 1 AS page, blob, o + (o_orderkey - 1) - s AS \"at\" FROM orders JOIN base ON o_orderkey - 1 >= s AND o_orderkey - 1 < s + n")
def page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.lookup(pages(spark, sf_dir).select("page"), _maps(spark, sf_dir)[0])


@query(f"""WITH {_PAGES}, {_MAPS}, bad AS (SELECT s, blob, page FROM (SELECT * FROM pts WHERE tag = 0) JOIN pages_ USING (page) WHERE page % 173 = 5 OR page % 59 = 0)
SELECT s AS start_page, blob, min(page) AS page FROM bad GROUP BY s, blob""")
def page_run_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, hashes = _maps(spark, sf_dir)[0], pages(spark, sf_dir)
    stored = P.lookup(hashes, base).filter("page % 59 <> 0")
    return P.run_mismatches(base, stored.select("blob", "at", F.when(F.col("page") % 173 == 5, "rotten").otherwise(F.col("hash")).alias("hash")), hashes)


@query("""WITH h AS (SELECT o_custkey AS page, o_orderkey AS ordinal, substring(sha256(o_orderpriority), 1, 32) AS hash FROM orders)
SELECT page, arg_max(hash, ordinal) AS hash FROM h WHERE page < (SELECT max(o_custkey) * 2 // 3 FROM orders) GROUP BY page""")
def materialize_hash_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.materialize(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("ordinal"), P.page_hash(F.col("o_orderpriority")).alias("hash")), largest(spark, sf_dir, "o_custkey") * 2 // 3)


@query("""WITH c AS (SELECT o_custkey AS snapshot, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, CAST(floor(o_totalprice) AS BIGINT) AS stored FROM orders),
t AS (SELECT snapshot, max(pos) AS depth, CAST(sum(stored) FILTER (pos = 0) AS BIGINT) AS key_bytes, CAST(coalesce(sum(stored) FILTER (pos > 0), 0) AS BIGINT) AS delta_bytes FROM c GROUP BY snapshot)
SELECT snapshot, CASE WHEN depth + 1 >= 30 OR delta_bytes > key_bytes THEN 0 ELSE depth + 1 END AS next_depth, key_bytes, delta_bytes, depth + 1 >= 30 OR delta_bytes > key_bytes AS keyframe FROM t""")
def keyframe_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    pos = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long")
    return P.keyframe_due(o.select(F.col("o_custkey").alias("snapshot"), pos.alias("pos"), F.floor("o_totalprice").alias("stored")))


@query("""WITH RECURSIVE s AS (SELECT 'p' || k AS snapshot_id, CASE WHEN k % 60 = 5 THEN 'gone' WHEN k % 60 = 12 THEN 'p' || (k + 11) WHEN k % 12 <> 0 THEN 'p' || (k - 1) END AS parent_id,
  CASE WHEN k % 60 = 12 THEN 12 ELSE k % 12 END AS depth, k % 12 = 11 OR k % 60 = 4 AS is_head FROM (SELECT p_partkey AS k FROM part)),
c AS (SELECT snapshot_id AS head, snapshot_id, parent_id, depth, 0 AS step FROM s WHERE is_head
  UNION ALL SELECT c.head, s.snapshot_id, s.parent_id, s.depth, c.step + 1 FROM s JOIN c ON s.snapshot_id = c.parent_id WHERE c.depth > 0 AND c.step < 30)
SELECT *, CASE WHEN step < max(step) OVER (PARTITION BY head) OR depth = 0 THEN NULL WHEN step = 30 THEN 'too long' ELSE 'missing parent' END AS problem FROM c""")
def snapshot_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of twelve parts; in every fifth one a parent is gone, in the one after it the keyframe's place leads back."""
    k = F.col("p_partkey")
    p = lambda n: F.concat(F.lit("p"), n.cast("string"))
    parent = F.when(k % 60 == 5, "gone").when(k % 60 == 12, p(k + 11)).when(k % 12 != 0, p(k - 1))
    part = table(spark, sf_dir, "part")
    s = part.select(p(k).alias("snapshot_id"), parent.alias("parent_id"), F.when(k % 60 == 12, 12).otherwise(k % 12).alias("depth"))
    return P.chains(s, part.filter((k % 12 == 11) | (k % 60 == 4)).select(p(k).alias("head")))


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments of snapshots: documents by source."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("snapshot_id"), F.col("doc_id").alias("pos"), F.sha2("text", 256).alias("hash"), F.col("n_chars").cast("long").alias("size"))


_REFS = "refs AS (SELECT source AS snapshot_id, doc_id AS pos, sha256(text) AS hash, CAST(n_chars AS BIGINT) AS size FROM documents)"


@query(f"WITH {_REFS} SELECT DISTINCT hash FROM refs WHERE pos % 2 = 0 AND hash NOT IN (SELECT hash FROM refs WHERE pos % 3 <> 0)")
def list_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = attachments(spark, sf_dir)
    return S.shrank(r.filter("pos % 2 = 0"), r.filter("pos % 3 <> 0"))


@query(f"WITH {_REFS} SELECT hash, min(pos) AS pos, arg_min(size, pos) AS size FROM refs WHERE hash NOT IN (SELECT hash FROM refs WHERE pos % 4 = 0) GROUP BY hash")
def capture_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = attachments(spark, sf_dir)
    return S.capture(r, r.filter("pos % 4 = 0"))


@query(f"""WITH {_REFS}, t AS (SELECT snapshot_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS b FROM (SELECT DISTINCT snapshot_id, hash, size FROM refs) GROUP BY snapshot_id),
m AS (SELECT snapshot_id, count(*) AS blobs, CAST(sum(size) AS BIGINT) AS bytes FROM refs GROUP BY snapshot_id)
SELECT snapshot_id, blobs, bytes, n AS found_blobs, b AS found_bytes FROM m JOIN t USING (snapshot_id) WHERE blobs <> n OR bytes <> b""")
def attachment_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = attachments(spark, sf_dir)
    return S.totals_problems(r.groupBy("snapshot_id").agg(F.count("*").alias("blobs"), F.sum("size").alias("bytes")), r)


@query(f"""WITH {_REFS}, idx AS (SELECT hash, min(size + CASE WHEN pos % 13 = 0 THEN 1 ELSE 0 END) AS raw_len FROM refs GROUP BY hash HAVING min(pos) % 10 <> 0)
SELECT snapshot_id, r.hash, CASE WHEN raw_len IS NULL THEN 'missing' ELSE 'size' END AS detail FROM refs r LEFT JOIN idx USING (hash) WHERE raw_len IS NULL OR raw_len <> size""")
def verify_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = attachments(spark, sf_dir)
    index = r.groupBy("hash").agg(F.min(F.col("size") + F.when(F.col("pos") % 13 == 0, 1).otherwise(0)).alias("raw_len"), F.min("pos").alias("p")).filter("p % 10 <> 0")
    return S.reference_problems(r, index)


@query("""WITH p AS (SELECT CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN '/abs' || p_partkey WHEN 2 THEN 'a/../b' || p_partkey WHEN 3 THEN 'a//b' || p_partkey WHEN 4 THEN 'dir./f' || p_partkey WHEN 5 THEN 'CON/f' || p_partkey
  WHEN 6 THEN 'Same/' || (p_partkey // 18) WHEN 7 THEN 'sAME/' || (p_partkey // 18) ELSE 'ok/' || p_partkey END AS path, p_partkey % 9 AS k, p_partkey // 18 AS h FROM part), c AS (SELECT lower(path) AS f FROM p GROUP BY 1 HAVING count(*) > 1)
SELECT path, CASE k WHEN 0 THEN 'empty' WHEN 1 THEN 'not relative' WHEN 2 THEN 'parent' WHEN 3 THEN 'not clean' WHEN 4 THEN 'trailing dot or space' WHEN 5 THEN 'reserved' ELSE 'collision' END AS problem FROM p WHERE k <= 5 OR lower(path) IN (SELECT f FROM c)""")
def path_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s, h = F.col("p_partkey") % 9, F.col("p_partkey").cast("string"), F.floor(F.col("p_partkey") / 18).cast("string")
    made = [("", None), ("/abs", s), ("a/../b", s), ("a//b", s), ("dir./f", s), ("CON/f", s), ("Same/", h), ("sAME/", h)]
    path = F.concat(F.lit("ok/"), s)
    for n, (lead, rest) in enumerate(made):
        path = F.when(k == n, F.concat(F.lit(lead), rest) if rest is not None else F.lit("")).otherwise(path)
    return S.path_problems(table(spark, sf_dir, "part").select(path.alias("path")), ("con", "nul"))


_SNAP = "strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || '-' || substring(sha256(o_orderpriority || o_orderkey), 1, 32)"


@query(f"SELECT o_orderkey, {_SNAP} AS snapshot_id FROM orders")
def snapshot_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", S.snapshot_id(F.col("o_orderdate"), F.concat("o_orderpriority", F.col("o_orderkey").cast("string"))).alias("snapshot_id"))


@query(f"SELECT max({_SNAP}) AS snapshot_id FROM orders WHERE o_orderkey % 2 = 0")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snapshot_id(spark, sf_dir).select(F.when(F.col("o_orderkey") % 2 == 0, F.col("snapshot_id")).otherwise(F.concat(F.lit("9"), F.col("snapshot_id"))).alias("snapshot_id"))
    return S.latest(s)


@query("""SELECT event_id, CASE WHEN parent IS NULL OR date_trunc('second', ts) > parent THEN date_trunc('second', ts) ELSE date_trunc('second', parent) + INTERVAL 1 SECOND END AS created_at
FROM (SELECT event_id, ts, CASE event_id % 3 WHEN 0 THEN ts + INTERVAL 1 HOUR WHEN 1 THEN date_trunc('second', ts) END AS parent FROM events)""")
def monotonic_created_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = F.col("ts"), F.col("event_id") % 3
    parent_ = F.when(k == 0, t + F.expr("INTERVAL 1 HOUR")).when(k == 1, F.date_trunc("second", t))
    return table(spark, sf_dir, "events").select("event_id", S.next_created(t, parent_).alias("created_at"))
