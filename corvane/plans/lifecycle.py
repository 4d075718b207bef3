"""Whole-store queries over the catalogue of documents: snapshots are sources, an index and its footers disagree here and there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import lifecycle as L
from corvane.plans import catalog, pages
from corvane.plans.catalog import _BASE, _LIVE, _PACKS, _USAGE
from corvane.plans.registry import query, table

_FOOT = """foot AS (SELECT pack_id, hash, "offset", stored_len + CASE WHEN crc32c % 19 = 5 THEN 1 ELSE 0 END AS stored_len, raw_len, flags, crc32c + CASE WHEN crc32c % 23 = 7 THEN 1 ELSE 0 END AS crc32c FROM entries WHERE crc32c % 17 <> 3),
faults AS (SELECT e.hash, e.pack_id, CASE WHEN f.hash IS NULL THEN 'footer missing' WHEN f.stored_len <> e.stored_len THEN 'footer stored_len' WHEN f.crc32c <> e.crc32c THEN 'footer crc32c' END AS footer FROM entries e LEFT JOIN foot f USING (pack_id, hash))"""
_REFS = "refs AS (SELECT source AS snapshot_id, pos, hash, size FROM blobs)"
_VERDICTS = f"""{_FOOT}, {_REFS}, verdicts AS (SELECT r.hash, e.stored_len + CASE WHEN crc32c % 29 = 0 THEN 1 ELSE 0 END AS raw_len, e.hash IS NOT NULL AND footer IS NULL AS structural,
  CASE WHEN e.hash IS NULL THEN 'missing' WHEN footer IS NOT NULL THEN footer WHEN crc32c % 31 = 0 THEN 'content' END AS detail FROM (SELECT DISTINCT hash FROM refs) r LEFT JOIN entries e USING (hash) LEFT JOIN faults f ON f.hash = r.hash)"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of which some tell another size than the snapshots do."""
    return catalog.entries(spark, sf_dir).withColumn("raw_len", F.col("stored_len") + F.when(F.col("crc32c") % 29 == 0, 1).otherwise(0))


def _payloads(index: DataFrame) -> DataFrame:
    """What the bytes of each entry hash to; some are rotten."""
    return index.select("hash", F.when(F.col("crc32c") % 31 == 0, "rotten").otherwise(F.col("hash")).alias("got"))


def _manifests(refs: DataFrame) -> DataFrame:
    return refs.groupBy("snapshot_id").agg(F.count("*").alias("blobs"), F.sum("size").alias("bytes"))


@query(f"""{_BASE}, {_VERDICTS}, m AS (SELECT snapshot_id, count(*) AS blobs, sum(size) AS bytes FROM refs GROUP BY ALL), t AS (SELECT snapshot_id, count(*) AS n, sum(size) AS b FROM (SELECT DISTINCT snapshot_id, hash, size FROM refs) GROUP BY ALL)
SELECT * FROM (SELECT snapshot_id, hash, coalesce(detail, CASE WHEN raw_len <> size THEN 'size' END) AS detail FROM (SELECT DISTINCT snapshot_id, hash, size FROM refs) JOIN verdicts USING (hash)) WHERE detail IS NOT NULL
UNION ALL SELECT snapshot_id, hash, 'repeated' FROM refs GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT snapshot_id, NULL, 'totals' FROM m JOIN t USING (snapshot_id) WHERE blobs <> n OR bytes <> b""")
def verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, index = pages.attachments(spark, sf_dir), _index(spark, sf_dir)
    return L.verify(_manifests(refs), refs, index, catalog.described(index), _payloads(index))


@query(f"{_BASE}, {_VERDICTS} SELECT count(*) FILTER (structural) AS blobs_checked, CAST(sum(raw_len) FILTER (detail IS NULL) AS BIGINT) AS bytes_read FROM verdicts")
def verify_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    return L.verify_counters(pages.attachments(spark, sf_dir), index, catalog.described(index), _payloads(index))


_PATHS = """lists AS (SELECT DISTINCT hash FROM blobs WHERE pos % 7 <> 0), paths AS (SELECT DISTINCT hash, CASE WHEN pos % 13 = 0 THEN '../' || pos WHEN pos % 10 = 0 THEN 'Dir/' || (pos // 20) ELSE 'dir/./f' || pos END AS path,
  CASE WHEN pos % 13 = 0 THEN '../' || pos WHEN pos % 10 = 0 THEN 'dir/' || (pos // 20) ELSE 'dir/f' || pos END AS f, pos % 13 = 0 AS up, pos % 10 <> 0 AS dot FROM blobs WHERE pos % 11 <> 0),
clash AS (SELECT f FROM paths GROUP BY f HAVING count(DISTINCT hash) > 1),
unequal AS (SELECT hash, NULL AS path, 'no path' AS problem FROM lists WHERE hash NOT IN (SELECT hash FROM paths) UNION ALL SELECT DISTINCT hash, NULL, 'unlisted' FROM paths WHERE hash NOT IN (SELECT hash FROM lists)
  UNION ALL SELECT hash, NULL, 'not indexed' FROM lists WHERE hash NOT IN (SELECT hash FROM entries)
  UNION ALL SELECT hash, path, CASE WHEN up THEN 'parent' WHEN dot THEN 'not clean' ELSE 'collision' END FROM paths WHERE up OR dot OR f IN (SELECT f FROM clash))"""


def _restored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = catalog.blobs(spark, sf_dir)
    p = F.col("pos")
    text = lambda c: c.cast("string")
    path = F.when(p % 13 == 0, F.concat(F.lit("../"), text(p))).when(p % 10 == 0, F.concat(F.lit("Dir/"), text(F.floor(p / 20)))).otherwise(F.concat(F.lit("dir/./f"), text(p)))
    return b.filter("pos % 7 <> 0").select("hash"), b.filter("pos % 11 <> 0").select("hash", path.alias("path"))


@query(f"{_BASE}, {_PATHS} SELECT hash, path, problem FROM unequal")
def list_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.list_equality(*_restored(spark, sf_dir), catalog.entries(spark, sf_dir))


_COMPACT = r"""regexp_replace({}, '("(?:[^"\\]|\\.)*")|[ \t\r\n]+', '\1', 'g')"""
_STATS = """stats AS (SELECT '{"user": ' || user_id || ', "note" : "a  \\" b", "n":[1, 2]}' AS manifest, CASE WHEN event_id % 9 = 4 THEN '{"note":"a  \\" b","user":' || user_id || ',"n":[1,2]}' ELSE '{"user":' || user_id || ',"note":"a  \\" b","n":[1,2]}' END AS restored, event_id FROM events)"""


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stats as written and as restored; some have another order of keys."""
    user = F.col("user_id").cast("string")
    manifest = F.concat(F.lit('{"user": '), user, F.lit(', "note" : "a  \\" b", "n":[1, 2]}'))
    swapped = F.concat(F.lit('{"note":"a  \\" b","user":'), user, F.lit(',"n":[1,2]}'))
    same = F.concat(F.lit('{"user":'), user, F.lit(',"note":"a  \\" b","n":[1,2]}'))
    return table(spark, sf_dir, "events").select("event_id", manifest.alias("manifest"), F.when(F.col("event_id") % 9 == 4, swapped).otherwise(same).alias("restored"))


@query(f"WITH {_STATS} SELECT event_id, {_COMPACT.format('manifest')} AS compact, event_id % 9 <> 4 AS same FROM stats")
def stats_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    compact = L.compact_json(F.col("manifest"))
    return _stats(spark, sf_dir).select("event_id", compact.alias("compact"), (compact == L.compact_json(F.col("restored"))).alias("same"))


@query(f"""{_BASE}, {_PATHS}, {pages._PAGES}, bad AS (SELECT 1 FROM pages_ a FULL JOIN parent b USING (page) WHERE a.hash IS DISTINCT FROM b.hash)
SELECT 'pages' AS "check", (SELECT count(*) FROM bad) AS problems UNION ALL SELECT 'lists', (SELECT count(*) FROM unequal) UNION ALL SELECT 'stats', (SELECT count(*) FROM events WHERE event_id % 9 = 4)""")
def restore_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.restore_proof(pages.pages(spark, sf_dir), pages.parent(spark, sf_dir), *_restored(spark, sf_dir), catalog.entries(spark, sf_dir), _stats(spark, sf_dir))


@query(f"{_BASE}, r AS (SELECT hash, min(pos) AS pos FROM blobs GROUP BY hash) SELECT min(r.pos) OVER (PARTITION BY pack_id) AS pack_order, pack_id, hash, r.pos FROM r JOIN entries USING (hash)")
def restore_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.restore_order(catalog.blobs(spark, sf_dir), catalog.entries(spark, sf_dir))


@query(f"""{_BASE}, {pages._PAGES}, {pages._RUNS}, a AS (SELECT hash, min(size) AS size FROM blobs WHERE pos % 3 <> 0 GROUP BY hash), seen AS (SELECT DISTINCT hash FROM blobs WHERE pos % 4 = 0)
SELECT (SELECT count(*) FROM dirty) AS dirty_pages, (SELECT count(*) FROM runs) AS dirty_runs, (SELECT count(*) FROM a) AS blobs, (SELECT CAST(sum(size) AS BIGINT) FROM a) AS bytes,
  (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM a WHERE hash NOT IN (SELECT hash FROM entries)) AS bytes_added, (SELECT count(*) FROM a WHERE hash NOT IN (SELECT hash FROM seen)) AS new_listed,
  (SELECT count(*) > 0 FROM seen WHERE hash NOT IN (SELECT hash FROM a)) AS relist""")
def create_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = catalog.blobs(spark, sf_dir).withColumn("stored_len", F.col("size"))
    return L.create(pages.pages(spark, sf_dir), pages.parent(spark, sf_dir), pages.parent_count(spark, sf_dir), b.filter("pos % 3 <> 0"), b.filter("pos % 4 = 0"), catalog.entries(spark, sf_dir))


@query(f"""{_BASE}, {_LIVE}, loose AS (SELECT DISTINCT hash FROM blobs WHERE pos % 3 <> 1) SELECT hash, 'prune' AS action FROM entries WHERE hash NOT IN (SELECT hash FROM members)
UNION ALL SELECT hash, CASE WHEN hash IN (SELECT hash FROM live) THEN 'remove' WHEN hash NOT IN (SELECT hash FROM members) THEN 'orphan' ELSE 'pack' END FROM loose""")
def maintain_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.pack(catalog.blobs(spark, sf_dir).filter("pos % 3 <> 1"), catalog.members(spark, sf_dir), catalog.entries(spark, sf_dir))


@query(f"""{_BASE}, {_PACKS}, {_LIVE}, {_USAGE}, {_FOOT}, c AS (SELECT *, live > 0 AS partial FROM used WHERE live = 0 OR (live <= (entry_count - 1) // 2 AND created_at <= TIMESTAMP '2034-01-01' - INTERVAL 24 HOURS AND stored_bytes - live_stored >= 1000)),
b AS (SELECT pack_id, count(*) AS problems FROM faults WHERE footer IS NOT NULL AND hash IN (SELECT hash FROM members) GROUP BY ALL)
SELECT row_number() OVER (ORDER BY partial, created_at, pack_id) - 1 AS rank, pack_id, partial, live AS moved, live_stored AS moved_bytes, coalesce(problems, 0) AS problems FROM c LEFT JOIN b USING (pack_id)""")
def maintain_repack(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2034-01-01").cast("timestamp")
    return L.repack(catalog.packs(spark, sf_dir), catalog.entries(spark, sf_dir), catalog.members(spark, sf_dir), catalog.footers(spark, sf_dir), now, min_dead=1000)


@query(f"""{_BASE}, {_PACKS}, {_LIVE}, {_FOOT}, n AS (SELECT pack_id, count(*) AS n, CAST(sum(raw_len) AS BIGINT) AS raw FROM live GROUP BY ALL), f2 AS (SELECT * FROM foot WHERE pack_id % 9 <> 4),
bad AS (SELECT DISTINCT l.pack_id FROM live l LEFT JOIN f2 f USING (pack_id, hash) WHERE f.hash IS NULL OR f.stored_len <> l.stored_len OR f.crc32c <> l.crc32c), p AS (SELECT * FROM packs WHERE pack_id % 8 <> 5)
SELECT pack_id, coalesce(n, 0) AS blobs_restored, coalesce(raw, 0) AS bytes_restored, CASE WHEN p.pack_id IS NULL THEN 'no record' WHEN n IS NOT NULL AND pack_id NOT IN (SELECT pack_id FROM f2) THEN 'missing' WHEN pack_id IN (SELECT pack_id FROM bad) THEN 'footer' END AS problem
FROM p FULL JOIN n USING (pack_id)""")
def maintain_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some packs have no record, the containers of some are gone."""
    packs, footers = catalog.packs(spark, sf_dir).filter("pack_id % 8 <> 5"), catalog.footers(spark, sf_dir).filter("pack_id % 9 <> 4")
    return L.unpack(packs, catalog.entries(spark, sf_dir), catalog.members(spark, sf_dir), footers)


_SELECTED = """sel AS (SELECT pack_id, hash, "offset" + CASE WHEN crc32c % 10 = 6 THEN 1 ELSE 0 END AS "offset", stored_len, raw_len, flags FROM entries UNION ALL SELECT pack_id, hash, "offset", stored_len, raw_len, flags FROM entries WHERE crc32c % 33 = 0)"""


@query(f"""{_BASE}, {_FOOT}, {_SELECTED}, n AS (SELECT hash, count(*) AS n FROM sel GROUP BY ALL)
SELECT s.pack_id, s.hash, CASE s.pack_id % 6 WHEN 1 THEN 'pack_encoding' WHEN 2 THEN 'pack_entry_count_limit' WHEN 3 THEN 'pack_container_limit' ELSE CASE WHEN n > 1 THEN 'duplicate' WHEN f.hash IS NULL THEN 'absent'
  WHEN f.stored_len <> s.stored_len OR f."offset" <> s."offset" THEN 'mismatch' WHEN f.raw_len > 20000 THEN 'blob_limit' ELSE 'adopt' END END AS outcome FROM sel s JOIN n USING (hash) LEFT JOIN foot f ON f.pack_id = s.pack_id AND f.hash = s.hash""")
def import_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = catalog.entries(spark, sf_dir)
    k = F.col("pack_id") % 6
    packs = e.select("pack_id").distinct().select("pack_id", (k != 1).alias("encoding_ok"), F.when(k == 2, 100_001).otherwise(40).alias("entry_count"), F.when(k == 3, 1 << 27).otherwise(1 << 20).cast("long").alias("data_bytes"))
    fields = ["pack_id", "hash", "offset", "stored_len", "raw_len", "flags"]
    moved = F.col("offset") + F.when(F.col("crc32c") % 10 == 6, 1).otherwise(0)
    selections = e.withColumn("offset", moved).select(*fields).unionByName(e.filter("crc32c % 33 = 0").select(*fields))
    return L.import_outcomes(packs, catalog.footers(spark, sf_dir), selections, blob_bytes=20_000)


@query(f"""{_BASE}, foots AS (SELECT pack_id, hash, "offset", CASE WHEN crc32c % 21 = 1 THEN 50000 ELSE 10 END AS stored_len, crc32c FROM entries UNION ALL SELECT pack_id, hash, "offset", 0, crc32c FROM entries WHERE crc32c % 33 = 0),
o AS (SELECT pack_id, hash, "offset", max("offset" + stored_len) OVER (PARTITION BY pack_id ORDER BY "offset", "offset" + stored_len, hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM foots WHERE stored_len > 0)
SELECT pack_id, hash, 'duplicate' AS problem FROM foots GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT pack_id, hash, 'overlap' FROM o WHERE "offset" < reach UNION ALL SELECT pack_id, hash, 'payload' FROM entries WHERE flags = 1 AND crc32c % 31 = 0""")
def import_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = catalog.entries(spark, sf_dir)
    long = e.withColumn("stored_len", F.when(F.col("crc32c") % 21 == 1, 50_000).otherwise(10).cast("long"))
    again = e.filter("crc32c % 33 = 0").withColumn("stored_len", F.lit(0).cast("long"))
    return L.import_proof(long.unionByName(again), e.filter("flags = 1"), _payloads(e))


@query(f"""{_BASE} SELECT hash, CASE WHEN min(pos) % 5 = 0 THEN 'present' WHEN min(pos) % 7 = 0 THEN 'missing' WHEN min(pos) % 11 IN (0, 1) THEN 'corrupt' ELSE 'copied' END AS outcome FROM blobs GROUP BY hash""")
def move_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = catalog.blobs(spark, sf_dir).groupBy("hash").agg(F.min("pos").alias("pos"), F.min("size").alias("size"))
    k = F.col("pos") % 11
    source = b.filter("pos % 7 <> 0").select("hash", (F.col("size") + F.when(k == 0, 1).otherwise(0)).alias("size"), F.when(k == 1, "rotten").otherwise(F.col("hash")).alias("got"))
    return L.move(b.select("hash", "size"), source, b.filter("pos % 5 = 0").select("hash"))


@query(f"{_BASE} SELECT substring(hash, 1, 2) AS shard, substring(hash, 1, 2) || '/' || hash AS path, hash, min(size) AS size FROM blobs WHERE hash NOT IN (SELECT hash FROM entries) GROUP BY hash")
def loose_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.loose_write(catalog.blobs(spark, sf_dir), catalog.entries(spark, sf_dir))


@query(f"""{_BASE} SELECT pack_id, count(*) AS blobs, min("offset") AS first_offset, max("offset" + stored_len) AS "end" FROM (SELECT DISTINCT hash FROM blobs) LEFT JOIN entries USING (hash) GROUP BY pack_id""")
def read_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.locate(catalog.blobs(spark, sf_dir), catalog.entries(spark, sf_dir))


@query("""WITH m AS (SELECT o_orderkey AS k, '20240101T000000Z-' || substring(sha256(CAST(o_orderkey AS VARCHAR)), 1, 32) AS id FROM orders)
SELECT CASE WHEN k % 6 = 1 THEN 'x' ELSE '' END || id AS name, CASE k % 6 WHEN 1 THEN 'id shape' WHEN 2 THEN 'no object' WHEN 3 THEN 'unknown field' WHEN 4 THEN 'newer reader' ELSE 'other id' END AS problem FROM m WHERE k % 6 <> 0""")
def manifest_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 6
    sid = F.concat(F.lit("20240101T000000Z-"), F.left(F.sha2(F.col("o_orderkey").cast("string"), 256), F.lit(32)))
    made = F.concat(F.lit('{"snapshot_id":"'), F.when(k == 5, "other").otherwise(sid), F.lit('","min_reader":'), F.when(k == 4, "9").otherwise("2"), F.when(k == 3, ',"extra":1').otherwise(""), F.lit("}"))
    m = table(spark, sf_dir, "orders").select(F.concat(F.when(k == 1, "x").otherwise(""), sid).alias("name"), F.when(k == 2, "[1]").otherwise(made).alias("json"))
    return L.manifest_problems(m, ["snapshot_id", "min_reader"], 3)


@query("""WITH a AS (SELECT o_custkey AS snapshot_id, CASE WHEN o_orderkey % 7 = 0 THEN 'Bad name' WHEN o_orderkey % 7 = 1 THEN 'same' ELSE 'a-' || o_orderkey END AS name, CAST(floor(o_totalprice * 40) AS BIGINT) AS size FROM orders)
SELECT snapshot_id, name, 'name' AS problem FROM a WHERE name = 'Bad name' UNION ALL SELECT snapshot_id, name, 'repeated' FROM a GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT snapshot_id, NULL, CASE WHEN count(*) > 64 THEN 'count' ELSE 'bytes' END FROM a GROUP BY snapshot_id HAVING count(*) > 64 OR sum(size) > 67108864""")
def artifact_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.when(k % 7 == 0, "Bad name").when(k % 7 == 1, "same").otherwise(F.concat(F.lit("a-"), k.cast("string")))
    return L.artifact_problems(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("snapshot_id"), name.alias("name"), F.floor(F.col("o_totalprice") * 40).alias("size")))


@query("""WITH r AS (SELECT l_orderkey AS snapshot_id, sha256(CAST(l_partkey % 50 AS VARCHAR)) AS hash, l_linenumber AS pos FROM lineitem), f AS (SELECT snapshot_id, hash, min(pos) AS first FROM r GROUP BY ALL)
SELECT snapshot_id, hash, row_number() OVER (PARTITION BY snapshot_id ORDER BY first, hash) - 1 AS place FROM f""")
def list_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("snapshot_id"), F.sha2((F.col("l_partkey") % 50).cast("string"), 256).alias("hash"), F.col("l_linenumber").alias("pos"))
    return L.list_positions(r)


@query(f"WITH {pages._MAPS} SELECT blob FROM base UNION SELECT blob FROM delta")
def blob_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.blob_table(*pages._maps(spark, sf_dir))
