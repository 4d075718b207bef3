"""The operators of this subpackage as queries over the test tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, decontam, embed_lsh, langid, licenses, minhash, quality, token_orc, urlrules, warc
from corvane.llm.shared import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


SITE_RULES = [
    urlrules.SiteRule("net", "/", "block"),
    urlrules.SiteRule("example.net", "/en/", "allow"),
    urlrules.SiteRule("example.com", "/de/", "block"),
    urlrules.SiteRule("org", "/fr/", "allow"),
]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "tokens").path("orc")
    token_orc.write_tokens(spark, table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), 0, path)
    return token_orc.token_digest(spark, path)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(spark, table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    evidence = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.judge(spark, docs, evidence, F.col("source"), F.concat_ws("/", "source", "lang")).select("doc_id", "source", "quality_score", "quality_kept")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_lsh.near_duplicate_vectors(spark, table(spark, sf_dir, "embeddings"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_languages(docs.filter(~held_out(F.col("doc_id"))))
    out = langid.identify(spark, docs, model, passed="accepted")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge_urls(spark, table(spark, sf_dir, "pages"), SITE_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.hits(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_minhash_dedup, op2_token_orc, op3_bpe, op4_warc, op5_quality, op6_embedding_dedup, op7_language, op8_url_rules, op9_licenses, op10_decontaminate, pipeline)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Reachability by repeated minimum over links; the recursion ends when no smaller id is reached.
_COMPONENTS = """
reach(id, low) AS (
  SELECT a, a FROM both_ways UNION SELECT l.b, r.low FROM reach r JOIN both_ways l ON l.a = r.id WHERE r.low < l.b
), component AS (SELECT id, min(low) AS low FROM reach GROUP BY id)"""

def _notice_sql(label: str, text: str, keys: tuple[str, ...]) -> str:
    """Every start from which a notice's key phrases stand, with how many of its words do; no index."""
    words = text.split()
    at = [(next(i for i in range(len(words)) if words[i : i + len(k)] == k), k) for k in (k.split() for k in keys)]
    o, n = at[0][0], len(words)
    stand = " AND ".join(f"w[i - {o - k} + 1 : i - {o - k} + {len(x)}] = {x!r}" for k, x in at)
    return f"""SELECT doc_id, '{label}' AS label, len(list_filter(range({n}), lambda k: w[i - {o} + k + 1] = {words!r}[k + 1])) AS same, {n} AS n
  FROM word WHERE w[i + 1] = '{at[0][1][0]}' AND i >= {o} AND i - {o} + {n} <= len(w) AND {stand}"""


def _license_sql() -> str:
    phrases = list(dict.fromkeys([p for p, _ in licenses.BASE] + [p for _, ps in licenses.TEMPLATES for p in ps]))
    rows = ", ".join(f"('{p}', {p.split()!r})" for p in phrases)
    labels = ", ".join(f"('{label}', ['{p}'], true)" for p, label in licenses.BASE) + ", " + ", ".join(f"('{label}', {list(ps)!r}, false)" for label, ps in licenses.TEMPLATES)
    return rf"""
WITH doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
phrase(p, words) AS (VALUES {rows}),
label(label, needs, base) AS (VALUES {labels}),
word AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM doc),
place AS (SELECT doc_id, p, i FROM word JOIN phrase ON w[i + 1] = words[1] WHERE w[i + 1 : i + len(words)] = words),
held AS (SELECT doc_id, list(DISTINCT p) AS ps FROM place GROUP BY doc_id),
notice AS (SELECT doc_id, label, max(same) / any_value(n)::DOUBLE AS share FROM ({" UNION ALL ".join(_notice_sql(*x) for x in licenses.NOTICES)}) WHERE same * 100 >= {licenses.SHARE} * n GROUP BY doc_id, label),
given AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share
  FROM (SELECT doc_id, label, base, 1.0::DOUBLE AS share FROM held JOIN label ON list_has_all(ps, needs) UNION ALL SELECT doc_id, label, false, share FROM notice) GROUP BY doc_id),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM place WHERE p IN ({", ".join(f"'{p}'" for p, _ in licenses.BASE)}) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN ps IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM doc d LEFT JOIN held USING (doc_id) LEFT JOIN given USING (doc_id) LEFT JOIN base USING (doc_id)"""


ORACLES: dict[str, str] = {
    "op1_minhash_dedup": rf"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM doc)
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link), {_COMPONENTS}
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(low, d.doc_id) AS component_id, coalesce(low, d.doc_id) = d.doc_id AS kept
FROM doc d LEFT JOIN size s ON s.doc_id = d.doc_id LEFT JOIN component c ON c.id = d.doc_id""",
    "op4_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY n, digest) AS top FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to FROM m""",
    "op6_embedding_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(e, lambda c: c <> 0)) > 0),
both_ways AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.93), {_COMPONENTS},
degree AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(low, v.vec_id) AS component_id, coalesce(low, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN degree ON a = v.vec_id LEFT JOIN component ON id = v.vec_id""",
    "op8_url_rules": r"""
WITH u AS (SELECT page_id, lower(coalesce(url, '')) AS low,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (SELECT u.*, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN regexp_matches(low, '[/.]ads?[/.]')
  OR regexp_matches(low, '/login(/|\?|$)') OR regexp_matches(low, '[?&]page=[0-9]+') OR regexp_matches(low, '/search[/?]')
  OR regexp_matches(low, '[?&](sid|session|phpsessid)=') THEN 'block' ELSE 'allow' END) AS verdict FROM f WHERE k = 1""",
    "op9_licenses": _license_sql(),
    "op10_decontaminate": rf"""
WITH doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, len(x) AS n, x FROM (SELECT item, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [w] ELSE list_transform(range(1, len(w) - 8), lambda i: w[i : i + 9]) END) AS x FROM item)),
long AS (SELECT DISTINCT n FROM win),
gram AS (SELECT doc_id, i, n, w[i + 1 : i + n] AS x FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM doc, long WHERE len(w) >= n)),
place AS (SELECT doc_id, i, g.n, item FROM gram g JOIN win ON win.n = g.n AND win.x = g.x),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM place)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM place) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM doc d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
