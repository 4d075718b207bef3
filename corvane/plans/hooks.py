"""Hook, terminal and remote-name queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import scalars, text
from corvane.operators import hooks, retrieval, stats
from corvane.plans.registry import query, table

#: Payloads of every shape, as SQL that both engines read.
_PAYLOAD = """CASE event_id % 9
  WHEN 0 THEN '{"hookEventName":"BeforeTool","toolName":"terminal","sessionId":"s' || user_id || '","extra":{"tool_call_id":"c' || event_id || '","result":"r"}}'
  WHEN 1 THEN '{"hook_event_name":"Stop","conversation_id":"s' || user_id || '","sessionId":"late","extra":{"user_message":"hi"},"prompt":null}'
  WHEN 2 THEN '{"hook_event_name":"Resume","session_id":null,"sessionId":"late"}'
  WHEN 3 THEN '{"session_id":"s"}' WHEN 4 THEN '{} {}' WHEN 5 THEN '[1]' WHEN 6 THEN '{"hook_event_name":7}'
  WHEN 7 THEN '{"hook_event_name":"Stop","extra":[1]}' ELSE '{"hook_event_name":"SessionEnd","tool_name":"Edit"}' END"""


@query("""SELECT event_id AS id, CASE event_id % 9 WHEN 0 THEN 'PreToolUse' WHEN 1 THEN 'Stop' WHEN 8 THEN 'SessionEnd' END AS route,
CASE event_id % 9 WHEN 2 THEN 'unsupported' WHEN 3 THEN 'event' WHEN 4 THEN 'not an object' WHEN 5 THEN 'not an object' WHEN 6 THEN 'type' WHEN 7 THEN 'extra' END AS problem,
CASE event_id % 9 WHEN 0 THEN 'Bash' WHEN 8 THEN 'Edit' END AS tool_name, CASE WHEN event_id % 9 IN (0, 1) THEN 's' || user_id WHEN event_id % 9 = 3 THEN 's' END AS session_id,
CASE event_id % 9 WHEN 0 THEN 'c' || event_id END AS tool_use_id, CASE event_id % 9 WHEN 0 THEN 'r' END AS tool_response, CAST(NULL AS VARCHAR) AS prompt FROM events""")
def hook_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of a native vocabulary with a nested object; prompt is present as null where the nested one would give it."""
    p = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.expr(_PAYLOAD).alias("json"))
    return hooks.normalize(p, {"BeforeTool": "PreToolUse"}, "terminal", nested=True).select("id", "route", "problem", "tool_name", "session_id", "tool_use_id", "tool_response", "prompt")


@query("SELECT event_id % 9 AS shape, count(*) FILTER (event_id % 9 IN (0, 1, 8)) AS routed, count(*) FILTER (event_id % 9 NOT IN (0, 1, 8)) AS refused FROM events GROUP BY ALL")
def hook_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.expr(_PAYLOAD).alias("json"))
    n = hooks.normalize(p, {"BeforeTool": "PreToolUse"}, "terminal", nested=True)
    return n.groupBy((F.col("id") % 9).alias("shape")).agg(F.count("route").alias("routed"), F.count("problem").alias("refused"))


_WIDE = text.WIDE
_SHOWN = r"regexp_replace(cell, '[\p{Mn}\p{Me}\p{Cf}\p{Cc}]', '', 'g')"
_CELLS = "SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN '漢字' WHEN 1 THEN 'e' || chr(769) || chr(8203) WHEN 2 THEN chr(128512) ELSE '' END AS cell FROM part"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    return table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.when(k == 0, "漢字").when(k == 1, "é​").when(k == 2, "\U0001f600").otherwise("")).alias("cell"))


@query(f"SELECT p_partkey, CAST(length({_SHOWN}) + length(regexp_replace({_SHOWN}, '[^{_WIDE}]', '', 'g')) AS INTEGER) AS width FROM ({_CELLS})")
def display_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select("p_partkey", text.display_width(F.col("cell")).alias("width"))


@query("""SELECT p_partkey, CASE WHEN length(p_name) + (CASE p_partkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END) <= 8 THEN p_name || CASE p_partkey % 4 WHEN 0 THEN '漢字' WHEN 1 THEN 'e' WHEN 2 THEN chr(128512) ELSE '' END ELSE substring(p_name, 1, 7) || '…' END AS shown FROM part""")
def truncate_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).filter(F.length(F.regexp_replace("cell", "[漢字é​\U0001f600]+$", "")) >= 0).join(table(spark, sf_dir, "part").filter("length(p_name) >= 7").select("p_partkey"), "p_partkey", "left_semi").select("p_partkey", text.truncate(F.col("cell"), 8).alias("shown"))


@query("""WITH c AS (SELECT o_custkey AS layout, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, length(CAST(o_orderkey AS VARCHAR)) + length(o_orderpriority) AS w FROM orders), m AS (SELECT layout, count(*) AS most FROM c GROUP BY ALL),
t AS (SELECT layout, k, i % k AS c, max(w) AS w FROM (SELECT c.*, unnest(range(1, most + 1)) AS k FROM c JOIN m USING (layout)) GROUP BY ALL), s AS (SELECT layout, k, sum(w) + 2 * (count(*) - 1) AS width FROM t GROUP BY ALL)
SELECT layout, CAST(k AS INTEGER) AS columns, CAST(width AS BIGINT) AS width FROM (SELECT *, row_number() OVER (PARTITION BY layout ORDER BY width <= 40 DESC, CASE WHEN width <= 40 THEN -k ELSE k END) AS r FROM s) WHERE r = 1""")
def layout_reflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("layout")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.col("o_orderpriority")).alias("t")))).alias("c"))
    return stats.reflow(o.select("layout", F.lit(0).alias("row"), F.col("c.t").alias("cells")), 40)


@query("""SELECT event_type AS instrument, CAST(user_id % 3 AS VARCHAR) AS attr, CAST((value > 10)::INT + (value > 50)::INT + (value > 100)::INT AS INTEGER) AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("instrument"), (F.col("user_id") % 3).cast("string").alias("attr"), "value")
    return stats.histogram(e, [10, 50, 100]).withColumn("total", F.round("total", 4))


_REMOTE = """CASE s_suppkey % 8 WHEN 0 THEN 'https://user@Host.org:8443/a/B' || s_suppkey || '.git' WHEN 1 THEN 'https://Host.org:443/a/B' || s_suppkey || '.git/' WHEN 2 THEN 'git@Host.org:a/B' || s_suppkey || '.git' WHEN 3 THEN 'ssh://git@host.org:22/a/b' || s_suppkey
  WHEN 4 THEN ' /srv/repo' || s_suppkey || ' ' WHEN 5 THEN 'git://host.org:9419/a/b' || s_suppkey WHEN 6 THEN 'file:///srv/x' || s_suppkey ELSE './rel' || s_suppkey END"""


@query("""SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN 'host.org:8443/a/B' || s_suppkey WHEN 1 THEN 'host.org/a/B' || s_suppkey WHEN 2 THEN 'host.org/a/B' || s_suppkey WHEN 3 THEN 'host.org/a/b' || s_suppkey
  WHEN 4 THEN '/srv/repo' || s_suppkey WHEN 5 THEN 'host.org:9419/a/b' || s_suppkey WHEN 6 THEN 'file:///srv/x' || s_suppkey ELSE './rel' || s_suppkey END AS identity, s_suppkey % 8 IN (4, 6, 7) AS is_local FROM supplier""")
def clone_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.expr(_REMOTE)
    return table(spark, sf_dir, "supplier").select("s_suppkey", scalars.remote_identity(u).alias("identity"), scalars.is_local_url(F.trim(u)).alias("is_local"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN '/base/host.org/a/b/n' || s_suppkey || '.git' WHEN s_suppkey % 7 = 6 THEN '/base/host.org/a/n' || s_suppkey || '.git' END AS path FROM supplier""")
def clone_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 7
    name = F.concat(F.lit("n"), F.col("s_suppkey").cast("string"))
    owner = F.when(k == 0, "a/b").when(k == 1, "a/../b").when(k == 2, "/a").when(k == 3, "a\\b").otherwise("a")
    host = F.when(k == 4, "h/x").when(k == 5, " host.org").otherwise("host.org")
    return table(spark, sf_dir, "supplier").select("s_suppkey", scalars.clone_path("/base/", host, owner, name).alias("path"))


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'https://h/' || s_suppkey WHEN 1 THEN 'https://h/q' || s_suppkey WHEN 4 THEN '' END AS url FROM supplier""")
def module_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("""CASE s_suppkey % 5 WHEN 0 THEN '  url = https://h/' || s_suppkey WHEN 1 THEN 'URL="https://h/q' || s_suppkey || '"' WHEN 2 THEN '# url = x' WHEN 3 THEN 'path = a' ELSE 'url =' END""")
    return table(spark, sf_dir, "supplier").select("s_suppkey", scalars.module_url(line).alias("url"))


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'origin/dev' WHEN 1 THEN 'dev' WHEN 2 THEN 'main' WHEN 3 THEN 'master' END AS branch FROM supplier""")
def default_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 5
    head = F.when(k <= 1, "dev").when(k == 2, "gone")
    remote = F.when(k == 0, F.array(F.lit("dev"))).otherwise(F.array(F.lit("other")))
    local = F.when(k == 1, F.array(F.lit("dev"), F.lit("main"))).when(k == 2, F.array(F.lit("master"), F.lit("main"))).when(k == 3, F.array(F.lit("master"))).otherwise(F.array(F.lit("x")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", scalars.default_branch(head, remote, local).alias("branch"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'json' WHEN 2 THEN 'text' END AS format FROM events")
def parse_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("", " JSON", "text", "xml")])
    return table(spark, sf_dir, "events").select("event_id", scalars.parse_format(F.element_at(names, (F.col("event_id") % 4 + 1).cast("int"))).alias("format"))


def _letters(texts: list[str]) -> list[list[float]]:
    """An encoder that refuses a text with `poison` and gives a zero vector for one without a vowel."""
    if any("poison" in t for t in texts):
        raise ValueError("poison")
    return [[float(t.count("a")), float(t.count("e")), float(t.count("o"))] for t in texts]


_BITS = "SELECT o_custkey AS doc, o_orderkey AS chunk_index, CASE o_orderkey % 40 WHEN 3 THEN ' ' WHEN 7 THEN 'poison' WHEN 11 THEN 'xyz' ELSE 'a' || lower(o_orderpriority) END AS text FROM orders"


@query(f"""WITH c AS ({_BITS}) SELECT doc, CAST(count(*) FILTER (text = ' ') AS BIGINT) AS blanks, count(*) FILTER (text = 'poison') > 0 OR count(*) FILTER (text = 'xyz') > 0 AS failed, CASE WHEN count(*) FILTER (text IN ('poison', 'xyz')) = 0 THEN
  CAST(sum(length(text) - length(replace(text, 'e', ''))) FILTER (text <> ' ') AS DOUBLE) END AS e_sum FROM c GROUP BY doc""")
def encode_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which a chunk can't be encoded fail alone; rows of a document stand together."""
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").cast("int").alias("chunk_index"), F.expr("CASE o_orderkey % 40 WHEN 3 THEN ' ' WHEN 7 THEN 'poison' WHEN 11 THEN 'xyz' ELSE 'a' || lower(o_orderpriority) END").alias("text"))
    v = retrieval.encode(c.repartition("doc").sortWithinPartitions("doc", "chunk_index"), _letters, 3, batch=16)
    bad = F.col("error").isin("ValueError", "invalid")
    total = F.sum(F.col("vector")[1].cast("double"))
    return v.groupBy("doc").agg(F.count_if(F.col("error") == "blank").alias("blanks"), F.max(F.coalesce(bad, F.lit(False))).alias("failed"), total.alias("s")).select("doc", "blanks", "failed", F.when(~F.col("failed"), F.col("s")).alias("e_sum"))
