"""Semi-structured, statistical and scalar queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import scalars, semistruct, text
from corvane.operators import stats
from corvane.plans.registry import query, table


@query("""SELECT event_id, event_type, coalesce(json_extract_string(props, '$.k'), '') AS k, 'spark' AS platform FROM events WHERE event_type IN ('purchase', 'signup', 'error')""")
def event_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed events with allowed properties, defaults over them."""
    e = table(spark, sf_dir, "events").filter(F.trim("event_type").isin("purchase", "signup", "error"))
    props = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("secret"), F.lit("x")))
    kept = semistruct.allowed_properties(props, ["k", "platform"], {"platform": "spark"})
    return e.select("event_id", "event_type", F.coalesce(F.element_at(kept, "k"), F.lit("")).alias("k"), F.element_at(kept, "platform").alias("platform")).filter("event_type is not null")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN NULL ELSE value END AS number, CASE WHEN event_type IN ('click', 'view') THEN event_type END AS kind FROM events""")
def property_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 4 == 0, "NaN").when(F.col("event_id") % 4 == 1, "many").otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", semistruct.finite_number(raw).alias("number"), semistruct.one_of(F.concat(F.lit(" "), F.col("event_type")), ["click", "view"]).alias("kind"))


_HOOK = "CASE event_id % 4 WHEN 0 THEN '{\"tool\":\"' || event_type || '\"}' WHEN 1 THEN '{\"toolName\":\"' || event_type || '\",\"x\":1}' WHEN 2 THEN '{\"tool\":null,\"toolName\":\"late\"}' ELSE '{\"other\":\"a\"}' END"


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type END AS tool, event_id % 4 <> 3 AS present FROM events")
def alias_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.expr(_HOOK)
    keys = F.json_object_keys(j)
    return table(spark, sf_dir, "events").select("event_id", semistruct.promoted(j, "tool", ["toolName", "name"]).alias("tool"), (F.array_contains(keys, "tool") | F.array_contains(keys, "toolName")).alias("present"))


@query("SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'x' WHEN 3 THEN 'other' ELSE '' END AS unknown, event_id % 5 <> 0 AS single FROM events")
def unknown_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.expr(_HOOK)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(semistruct.unknown_fields(j, ["tool", "toolName"]), ",").alias("unknown"), semistruct.single_object(F.concat(j, F.when(F.col("event_id") % 5 == 0, " {}").otherwise(" "))).alias("single"))


@query("""WITH s AS (SELECT event_type AS instrument, CAST(user_id % 3 AS VARCHAR) AS attr, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY ALL)
SELECT i.instrument, attr, coalesce(total, 0.0) AS total, coalesce(n, 0) AS n FROM (VALUES ('click'), ('view'), ('never')) i(instrument) LEFT JOIN s ON s.instrument = i.instrument""")
def deferred_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("instrument"), (F.col("user_id") % 3).cast("string").alias("attr"), "value")
    names = spark.createDataFrame([("click",), ("view",), ("never",)], "instrument string")
    return stats.counters(names, e).withColumn("total", F.round("total", 4))


@query("SELECT event_type AS instrument, CAST(user_id % 5 AS VARCHAR) AS attr, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def gauge_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.gauges(table(spark, sf_dir, "events").select(F.col("event_type").alias("instrument"), (F.col("user_id") % 5).cast("string").alias("attr"), "value", F.col("event_id").alias("seq")))


@query("""WITH s AS (SELECT event_type AS name, CASE user_id % 4 WHEN 0 THEN 'sec/op' WHEN 1 THEN 'B/op' WHEN 2 THEN 'allocs/op' ELSE 'misc' END AS unit, day(ts) % 2 AS side, value * CASE WHEN event_type = 'click' AND day(ts) % 2 = 1 THEN 5 ELSE 1 END AS value FROM events),
m AS (SELECT name, unit, median(value) FILTER (side = 0 AND NOT (name = 'view' AND unit = 'misc')) AS old, median(value) FILTER (side = 1) AS new FROM s GROUP BY ALL),
g(unit, most, floor, sig) AS (VALUES ('sec/op', 2.0, 0.0001, true), ('allocs/op', 1.2, 8, false), ('B/op', 1.25, 4096, false))
SELECT name, m.unit, round(old, 6) AS old, round(new, 6) AS new, CASE WHEN old IS NULL THEN 'new' WHEN new IS NULL THEN 'missing' WHEN most IS NULL OR old <= 0 OR old < floor THEN 'skipped' WHEN new / old <= most THEN 'ok' ELSE 'regression' END AS verdict
FROM m LEFT JOIN g USING (unit)""")
def bench_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd days against even ones; clicks got five times slower, far beyond chance."""
    odd = F.dayofmonth("ts") % 2
    unit = F.element_at(F.array(F.lit("sec/op"), F.lit("B/op"), F.lit("allocs/op"), F.lit("misc")), (F.col("user_id") % 4 + 1).cast("int"))
    slower = F.when((F.col("event_type") == "click") & (odd == 1), 5).otherwise(1)
    s = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), unit.alias("unit"), odd.alias("side"), (F.col("value") * slower).alias("value"))
    old = s.filter("side = 0 and not (name = 'view' and unit = 'misc')").drop("side")
    return stats.compare(old, s.filter("side = 1").drop("side")).withColumn("old", F.round("old", 6)).withColumn("new", F.round("new", 6))


@query("""WITH s AS (SELECT o_orderkey, CAST(floor(o_totalprice * CASE o_orderkey % 4 WHEN 0 THEN 0.001 WHEN 1 THEN 1 WHEN 2 THEN 1000 ELSE 100000 END) AS BIGINT) AS n FROM orders)
SELECT o_orderkey, CASE WHEN n >= 1073741824 THEN format('{:.1f} GB', n / 1073741824.0) WHEN n >= 1048576 THEN format('{:.1f} MB', n / 1048576.0) WHEN n >= 1024 THEN format('{:.1f} KB', n / 1024.0) ELSE n || ' B' END AS size FROM s""")
def format_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale = F.when(F.col("o_orderkey") % 4 == 0, 0.001).when(F.col("o_orderkey") % 4 == 1, 1.0).when(F.col("o_orderkey") % 4 == 2, 1000.0).otherwise(100000.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", text.format_size(F.floor(F.col("o_totalprice") * scale)).alias("size"))


@query(r"""SELECT page_id, lower(regexp_extract(url, '://([^/:?#]+)', 1)) AS host, regexp_replace(regexp_replace(regexp_extract(url, '://[^/?#]*/?([^?#]*)', 1), '^/+|/+$', '', 'g'), '\.git$', '') AS path FROM pages""")
def remote_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", scalars.remote_host(u).alias("host"), scalars.remote_path(u).alias("path"))


@query("""SELECT p_partkey, (p_size % 4) * 10000 + (p_size % 7) * 100 + p_partkey % 10 > 20305 OR ((p_size % 4) * 10000 + (p_size % 7) * 100 + p_partkey % 10 = 20305 AND p_partkey % 3 <> 0) AS newer FROM part""")
def semver_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a version comes after v2.3.5-rc2; every third is a first release candidate."""
    part = lambda c: c.cast("string")
    v = F.concat(F.lit("v"), part(F.col("p_size") % 4), F.lit("."), part(F.col("p_size") % 7), F.lit("."), part(F.col("p_partkey") % 10), F.when(F.col("p_partkey") % 3 == 0, "-rc1").otherwise("+build5"))
    return table(spark, sf_dir, "part").select("p_partkey", (scalars.version_key(v) > scalars.version_key(F.lit("v2.3.5-rc2"))).alias("newer"))


@query("""SELECT o_custkey AS name, string_agg(o_custkey || '=' || o_orderpriority, ',' ORDER BY o_orderkey) AS options FROM orders GROUP BY o_custkey""")
def canonical_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("name"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("value"))
    return stats.canonical_options(o).select(F.col("name").cast("long").alias("name"), F.array_join("options", ",").alias("options"))


@query("SELECT CAST(i AS INTEGER) AS col, CAST(max(length(c)) AS INTEGER) AS width FROM (SELECT unnest(range(len(cells))) AS i, unnest(cells) AS c FROM (SELECT [p_name, p_brand, p_type] AS cells FROM part)) GROUP BY i")
def column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.column_widths(table(spark, sf_dir, "part").select(F.array("p_name", "p_brand", "p_type").alias("cells")))


@query("""WITH r AS (SELECT s_suppkey AS route, ['h' || (s_suppkey % 7), 'h' || (s_suppkey % 5), 'h99'] AS hops FROM supplier), h AS (SELECT route, unnest(range(3)) AS pos, unnest(hops) AS hop FROM r)
SELECT route, CAST(pos AS INTEGER) AS pos, hop, CASE WHEN hop <> 'h99' THEN hop || ':22' END AS endpoint, CASE WHEN hop = 'h99' THEN 'unknown' WHEN hop = 'h3' THEN 'nested' END AS problem FROM h""")
def route_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    routes = table(spark, sf_dir, "supplier").select(k.alias("route"), F.concat(F.lit("h"), (k % 7).cast("string"), F.lit(",h"), (k % 5).cast("string"), F.lit(",h99")).alias("hops"))
    config = spark.createDataFrame([(f"h{i}", f"h{i}:22", "h1" if i == 3 else "") for i in range(7)], "name string, endpoint string, proxy string")
    return stats.expand_routes(routes, config)


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'warn' WHEN 1 THEN 'debug' WHEN 2 THEN 'error' ELSE 'info' END AS level FROM events")
def parse_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in (" Warning ", "DEBUG", "error", "loud", "")])
    return table(spark, sf_dir, "events").select("event_id", scalars.parse_level(F.element_at(names, (F.col("event_id") % 5 + 1).cast("int"))).alias("level"))


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, sf_dir, "events").withColumn("k", k).filter("k <= 5").select("event_type", "event_id")


@query("SELECT n_regionkey, coalesce(min(n_nationkey) FILTER (n_name > 'M'), -1) AS n_nationkey FROM nation GROUP BY n_regionkey")
def first_acceptable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each group that passes, else a default."""
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.coalesce(F.min(F.when(F.col("n_name") > "M", F.col("n_nationkey"))), F.lit(-1)).alias("n_nationkey"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'b/' || c_custkey WHEN c_nationkey % 3 = 1 THEN CAST(c_custkey AS VARCHAR) ELSE 'main' END AS branch FROM customer""")
def strip_remote_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest matching remote wins: team/x before team."""
    ref = F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit("team/b/"), F.col("c_custkey").cast("string"))).when(F.col("c_nationkey") % 3 == 1, F.concat(F.lit("team/x/"), F.col("c_custkey").cast("string"))).otherwise("main")
    remotes = spark.createDataFrame([("team/",), ("team/x/",), ("origin/",)], "prefix string")
    return stats.strip_prefix(table(spark, sf_dir, "customer").select("c_custkey", ref.alias("branch")), remotes, "branch")


@query("""SELECT s_suppkey, sha256(from_hex(lpad(hex(length(s_name)), 16, '0') || hex(encode(s_name)) || lpad(hex(octet_length(encode(CAST(s_nationkey AS VARCHAR)))), 16, '0') || hex(encode(CAST(s_nationkey AS VARCHAR))))) AS identity FROM supplier""")
def identity_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", scalars.identity_digest(F.col("s_name"), F.col("s_nationkey").cast("string")).alias("identity"))


@query("SELECT doc_id, substring(sha256(text), 1, 7) AS sha, doc_id % 3 <> 0 AS looks FROM documents")
def short_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.left(F.sha2("text", 256), F.lit(40))
    return table(spark, sf_dir, "documents").select("doc_id", scalars.short_sha(h).alias("sha"), scalars.looks_like_sha(F.when(F.col("doc_id") % 3 == 0, F.concat(h, F.lit("x"))).otherwise(h)).alias("looks"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'yes' WHEN 2 THEN 'no' ELSE event_type END AS value FROM events")
def normal_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("event_id") % 4 == 0, "None").when(F.col("event_id") % 4 == 1, "true").when(F.col("event_id") % 4 == 2, "FALSE").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", scalars.normal_option(v).alias("value"))
