"""Document quality by hierarchical empirical Bayes.

Evidence: a logistic regression on surface features of the whole text and on which significant words it holds,
fitted on a bounded sample of labelled documents, gives each document a log-odds. Sites: for every host and every
path of a host the documents' probabilities are summed by grouped aggregation; a host's posterior mean shrinks to
the global mean and a path's to its host's, by prior strengths found from the spread between sites (method of
moments), so that a site with few documents says little. Combination: the document's log-odds plus a fraction of
how far its path's posterior log-odds is from the global one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.shared import IS_SPACE, Scratch, bound_batches, fresh, held, word_hashes

WORD_BUCKETS = 1 << 20
#: Sites up to this number are broadcast (about 60 bytes each); beyond it they are joined by a shuffle.
BROADCAST_SITES = 100_000
FEATURES = 12


_MARKS = b".,;:!?\"'()"
_ENDS, _SIGNS, _DIGITS = (np.frombuffer(x, np.uint8) for x in (b".!?", b"$%&#*|@^~=<>{}[]\\_", b"0123456789"))
#: Of a byte whether a word that ends with it ends in a mark: neither letter nor digit nor beyond ASCII.
_IS_MARK = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)]) & ~IS_SPACE


def surface(data: bytes) -> tuple[list[float], np.ndarray]:
    """Of a text's lower-cased UTF-8 bytes: shares and logarithms that tell prose from lists, symbol noise and repetition,
    and the buckets of its distinct words. Words are taken without marks."""
    b, h = np.frombuffer(data, np.uint8), word_hashes(data.translate(None, _MARKS))
    n, size, count, kinds = max(1, len(h)), max(1, len(b)), np.bincount(b, minlength=256), np.unique(h)
    after = np.append(IS_SPACE[b[1:]], True)[: len(b)]  # of each byte whether a word ends with it
    signs = count[_SIGNS].sum()
    dense = [
        np.log1p(len(h)), min(40, size / n) / 10, signs / n, min(1, 20 * signs / size), count[_DIGITS].sum() / size, count[_ENDS].sum() / n, np.count_nonzero(_IS_MARK[b] & after) / n,
        np.count_nonzero(h[1:] == h[:-1]) / n, len(kinds) / n**0.75, count[ord("|")] / n, count[10] / n, 1.0,
    ]
    return dense, np.unique(kinds >> np.uint64(44)).astype(np.int64)


def lower_bytes(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


@dataclass
class Evidence:
    """weights of the standardised features; log-odds of word buckets that go with one class, else 0."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    words: np.ndarray
    threshold: float = 0.5

    def log_odds(self, dense: np.ndarray, word_sum: np.ndarray) -> np.ndarray:
        z = np.clip((dense[:, :-1] - self.mean) / self.scale, -8, 8)
        return np.clip(np.column_stack((z, word_sum, np.ones(len(z)))) @ self.weights, -12, 12)


def fit_evidence(dense: np.ndarray, keys: list[np.ndarray], good: np.ndarray) -> Evidence:
    """Logistic regression by Newton's steps with a ridge; words by smoothed log-odds where |z| > 4.

    Without examples of both classes the evidence is 0 for every document.
    """
    n = len(good)
    words = np.zeros(WORD_BUCKETS)
    if n == 0 or good.all() or not good.any():
        return Evidence(np.zeros(FEATURES - 1), np.ones(FEATURES - 1), np.zeros(FEATURES + 1), words)
    counts = [np.bincount(np.concatenate([k for k, g in zip(keys, good, strict=True) if g == c] or [np.empty(0, int)]).astype(int), minlength=WORD_BUCKETS) for c in (0, 1)]
    bad_n, good_n = (good == 0).sum(), (good == 1).sum()
    pb, pg = (counts[0] + 0.5) / (bad_n + 1), (counts[1] + 0.5) / (good_n + 1)
    pooled = (counts[0] + counts[1] + 1) / (n + 2)
    z = (pg - pb) / np.sqrt(pooled * (1 - pooled) * (1 / bad_n + 1 / good_n))
    # words that nearly only one class has: function words that vary with length and topic are left out
    words = np.where((np.abs(z) > 4) & (np.abs(np.log(pg / pb)) > np.log(8)), np.clip(np.log(pg / pb), -4, 4), 0.0).astype(np.float32)
    sums = np.array([words[k].sum() for k in keys])
    mean, scale = dense[:, :-1].mean(axis=0), dense[:, :-1].std(axis=0) + 1e-6
    x = np.column_stack((np.clip((dense[:, :-1] - mean) / scale, -8, 8), np.clip(sums, -12, 12), np.ones(n)))
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), 1.0)
    ridge[-1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(ridge), x.T @ (good - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Evidence(mean, scale, w, words)


def _table(docs: DataFrame, extra: list[str]) -> DataFrame:
    """doc_id with the features and word buckets of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dense, keys = [], []
            for t in batch.column(1):
                shares, words = surface(lower_bytes(t.as_py()))
                dense.append(shares)
                keys.append(words)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(dense, pa.list_(pa.float64())), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", *extra, "dense", "keys"])

    kinds = dict(docs.dtypes)
    return docs.select("doc_id", "text", *extra).mapInArrow(run, ", ".join(["doc_id long", *[f"{c} {kinds[c]}" for c in extra], "dense array<double>", "keys array<long>"]))


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = 6000) -> Evidence:
    """Fit the evidence on at most `most` labelled documents, a bounded sample spread by a hash of doc_id.

    labels(doc_id, quality, toxic): good is quality 1 without toxic 1; rows with a null quality don't count; of texts with
    the same doc_id the smallest counts. Only the sample's features come to the driver (about 1 KB a document).
    """
    bound_batches(docs.sparkSession)
    rows = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1), 1).otherwise(0)).alias("good"))
    picked = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("good").alias("good"))
    got = sorted(_table(sample, ["good"]).collect(), key=lambda r: (r.doc_id, r.dense))
    return fit_evidence(np.array([r.dense for r in got]).reshape(-1, FEATURES), [np.array(r["keys"], int) for r in got], np.array([r.good for r in got]))


def evidence_column(spark: SparkSession, evidence: Evidence, text: Column) -> Column:
    """The classifier's log-odds of a text; a null or blank one has that of no words."""
    bound_batches(spark)
    key = hashlib.sha256(evidence.words.tobytes() + evidence.weights.tobytes()).hexdigest()
    sent = spark.sparkContext.broadcast(evidence)  # WORD_BUCKETS numbers, whatever the corpus

    def run(series: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = held(("quality", key), lambda: sent.value)
        for column in series:
            dense, sums = [], []
            for t in column:
                shares, words = surface(lower_bytes(t.as_py()))
                dense.append(shares)
                sums.append(min(12.0, max(-12.0, e.words[words].sum())))
            yield pa.array(e.log_odds(np.array(dense).reshape(-1, FEATURES), np.array(sums)) if dense else [], pa.float64())

    return F.arrow_udf(run, "double")(text.cast("string"))


def site_posteriors(scratch: Scratch, scored: DataFrame) -> DataFrame:
    """From (host, path, p): (host, path, shift), how far the path's posterior log-odds is from the global one.

    Null hosts and paths are sites of their own; a null p doesn't count. The sums have a row for each path and are
    written once, so the rows are scored once; a host that holds a third of all rows is summed before it moves.
    """
    sums = scored.filter("p is not null").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    paths = scratch.keep(sums, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))

    def prior(sites: DataFrame, n: str, s: str) -> tuple[float, float]:
        """Global mean and prior strength: how many documents the prior is worth, by the spread between sites."""
        r = sites.agg(F.sum(s).alias("ts"), F.sum(n).alias("tn"), F.count("*").alias("k"), F.sum(F.col(s) * F.col(s) / F.col(n)).alias("q"), F.sum((F.col(n) * F.col(n)).cast("double")).alias("n2")).first()
        if not r.tn:
            return 0.5, 1.0
        mean = min(max(r.ts / r.tn, 1e-4), 1 - 1e-4)
        within = mean * (1 - mean)
        between = max((r.q - r.tn * mean * mean - (r.k - 1) * within) / max(r.tn - r.n2 / r.tn, 1.0), within / 200)
        return mean, max(within / between - 1, 1.0)

    mean, of_hosts = prior(hosts, "hn", "hs")
    _, of_paths = prior(paths, "n", "s")
    top = hosts.select(F.col("host").alias("h2"), ((F.col("hs") + of_hosts * mean) / (F.col("hn") + of_hosts)).alias("hp"))
    both = paths.join(top, F.col("host").eqNullSafe(F.col("h2")))

    def odds(c: Column) -> Column:
        c = F.least(F.greatest(c, F.lit(1e-4)), F.lit(1 - 1e-4))
        return F.log(c / (1 - c))

    post = (F.col("s") + of_paths * F.col("hp")) / (F.col("n") + of_paths)
    return both.select("host", "path", (odds(post) - odds(F.lit(mean))).alias("shift"))


def judge(spark: SparkSession, docs: DataFrame, evidence: Evidence, host: Column, path: Column, weight: float = 0.3, threshold: float = 0.5) -> DataFrame:
    """docs with `quality_score` (0 to 1), `quality_evidence` (log-odds) and `quality_kept` (score >= threshold).

    Every other column stays, whatever its name; columns of these three names are replaced. Null texts are judged as
    empty ones; repeated rows count each time. The texts are read twice, once for the sites' sums and once for the
    result, and never move: sites are broadcast up to BROADCAST_SITES rows, else only (row's site key) is joined by a
    shuffle that adaptive execution splits. The table of sites stays in the shared folder, as the result reads it.
    """
    p = lambda z: 1 / (1 + F.exp(-z))
    logit = evidence_column(spark, evidence, F.col("text"))
    scored = docs.select(host.alias("host"), path.alias("path"), logit.alias("z")).select("host", "path", p(F.col("z")).alias("p"))
    scratch = Scratch(spark, "sites")
    of_host, of_path, of_row, of_rows_path, shift = (fresh(docs.columns, c) for c in ("site_host", "site_path", "row_host", "row_path", "site_shift"))
    sites = scratch.keep(site_posteriors(scratch, scored), "sites").select(F.col("host").alias(of_host), F.col("path").alias(of_path), F.col("shift").alias(shift))
    if sites.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES:
        sites = F.broadcast(sites)
    keep = [c for c in docs.columns if c.lower() not in ("quality_score", "quality_evidence", "quality_kept")]
    rows = docs.select(*keep, logit.alias("quality_evidence"), host.alias(of_row), path.alias(of_rows_path))
    out = rows.join(sites, F.col(of_row).eqNullSafe(F.col(of_host)) & F.col(of_rows_path).eqNullSafe(F.col(of_path)), "left")
    score = p(F.col("quality_evidence") + weight * F.coalesce(shift, F.lit(0.0)))
    return out.select(*keep, "quality_evidence", score.alias("quality_score"), (score >= threshold).alias("quality_kept"))
