"""Language and quality: held-out accuracy and the odd cases."""

import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import entries, langid, quality
from corvane.llm.shared import Scratch

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_held_out(spark, docs):
    got = entries.op7_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 200
    assert sum(r.lang_pred == r.lang for r in got) >= 0.98 * len(got)
    assert sum(r.accepted for r in got) >= 0.98 * len(got) and all(0 <= r.score <= 1 for r in got)


def slow_buckets(text):
    """The documented features, gram by gram."""
    out, one = [], 0x01000193

    def bucket(h):
        h &= 0xFFFFFFFF
        return ((h ^ h >> 15) * 0x9E3779B1 & 0xFFFFFFFF) >> 17

    low = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    if not any(unicodedata.category(c)[0] == "L" for c in low):
        return out
    for word in low.split():
        codes = [0, *map(ord, word), 0]
        for n in (1, 2, 3, 4):
            for i in range(len(codes) - n + 1):
                if n == 1 and not codes[i]:
                    continue
                h = codes[i]
                for c in codes[i + 1 : i + n]:
                    h = h * one + c & 0xFFFFFFFF
                out.append(bucket(h + n))
        whole = [(ord(c) ^ k * 0x9E3779B1 & 0xFFFFFFFF) * one & 0xFFFFFFFF for k, c in enumerate([*word, chr(0)])]  # with the mark at its end
        out.append(bucket(sum(x ^ x >> 15 for x in whole) + 5))
    return out


@pytest.mark.parametrize("text", ["", " 12 ", "a", "Hello, World!", "ab cd", "  x  y ", "e\u0301te d'été", "I\u0130 ß 日本 a1b2"])
def test_buckets_are_the_grams_of_words(text):
    assert sorted(langid.text_buckets(text).tolist()) == sorted(slow_buckets(text))


def test_scores_against_brute_force(spark, docs):
    """With the model given, each row's answer is the softmax of the average of its buckets' rows."""
    model = langid.fit_languages(docs, most=150)
    some = docs.orderBy("doc_id").limit(25)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark, some, model).collect()}
    for r in some.collect():
        b = slow_buckets(r.text)
        z = (np.mean([model.weights[k] for k in b], axis=0) + model.bias) / model.temperature if b else None
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum() if b else [0.0]
        assert got[r.doc_id][0] == (model.languages[int(np.argmax(p))] if b else "und")
        assert got[r.doc_id][1] == pytest.approx(max(p), abs=1e-6)


def test_names_that_clash(spark, docs):
    names = ["language", "__language", "site_host", "site_path", "row_host", "row_path", "site_shift", "Quality_Score"]
    df = docs.select("doc_id", "text", *[F.lit(k).alias(n) for k, n in enumerate(names)]).limit(20)
    out = langid.identify(spark, df, langid.fit_languages(docs, most=60))
    assert out.columns == [*df.columns, "lang_pred", "score"] and out.filter("language = 0 and __language = 1").count() == 20
    e = quality.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"), most=100)
    judged = quality.judge(spark, df, e, F.col("site_host"), F.col("row_path"))
    assert judged.filter("site_host = 2 and row_path = 5 and site_shift = 6").count() == 20


def test_language_odd_rows(spark, docs):
    model = langid.fit_languages(docs, most=200)
    rows = [(1, None, "a"), (2, "", "b"), (3, " 12 $$ ", "c"), (4, "the and of", "d"), (5, "é" * 100_000, "e"), (4, "the and of", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = langid.identify(spark, df, model, passed="ok").collect()
    assert len(got) == 6 and got[0].asDict().keys() == {"doc_id", "text", "score", "lang_pred", "ok"}
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[1].score == 0 and not by[1].ok
    assert by[4].lang_pred in model.languages
    assert langid.identify(spark, df.filter("false"), model).count() == 0
    none = langid.fit_languages(docs.filter("false"))
    assert {r.score for r in langid.identify(spark, df, none).collect()} <= {0.0, 1.0}


def test_rejection_threshold_holds_on_calibration():
    words = {"a": ["alpha", "able", "atom"], "b": ["bear", "blue", "bone"]}
    texts = [" ".join(np.random.default_rng(k).choice(words["ab"[k % 2]], 20)) for k in range(200)]
    m = langid.train(texts, ["ab"[k % 2] for k in range(200)])
    p = m.scores(np.array([langid.average(t, m.weights) for t in texts]))
    assert (p.argmax(axis=1) == np.arange(200) % 2).all() and (p.max(axis=1) >= m.threshold).mean() > 0.99


def test_quality_held_out(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    fit, held = labels.filter("doc_id % 3 <> 1"), labels.filter("doc_id % 3 = 1")
    out = quality.judge(spark, docs, quality.fit_quality(docs, fit), F.col("source"), F.concat_ws("/", "source", "lang"))
    got = out.join(held, "doc_id").select("quality", "toxic", "quality_kept", "quality_score").collect()
    clean, junk = [r for r in got if r.quality == 1 and not r.toxic], [r for r in got if r.quality == 0]
    assert sum(r.quality_kept for r in clean) >= 0.97 * len(clean)
    assert sum(not r.quality_kept for r in junk) >= 0.7 * len(junk)


def test_quality_odd_rows(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    e = quality.fit_quality(docs, labels)
    rows = [(1, None, None, 1), (2, "", "s", 2), (3, "$$$ %%% | |", "s", 3), (4, "x" * 300_000, None, 4), (4, "x", None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, quality_score int")
    got = quality.judge(spark, df, e, F.col("source"), F.col("source")).collect()
    assert len(got) == 5 and all(0 <= r.quality_score <= 1 for r in got)
    assert quality.judge(spark, df.filter("false"), e, F.col("source"), F.col("source")).count() == 0
    blank = quality.fit_quality(docs, labels.filter("false"))
    assert {r.quality_kept for r in quality.judge(spark, df, blank, F.col("source"), F.col("source")).collect()} == {True}


def test_judge_against_brute_force(spark, docs):
    """The documented posteriors, computed row by row in Python from each document's own evidence."""
    e = quality.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"), most=200)
    some = docs.select("doc_id", "text", F.when(F.col("doc_id") % 7 > 0, F.col("source")).alias("source"), "lang")
    got = {r.doc_id: r for r in quality.judge(spark, some, e, F.col("source"), F.concat_ws("/", "source", "lang"), weight=0.3).collect()}
    hosts, paths = {}, {}
    for r in got.values():
        p = 1 / (1 + np.exp(-r.quality_evidence))
        path = (r.source, "/".join(x for x in (r.source, r.lang) if x is not None))
        for table, key in ((hosts, r.source), (paths, path)):
            table.setdefault(key, []).append(p)

    def prior(groups):
        n, s = np.array([len(g) for g in groups]), np.array([sum(g) for g in groups])
        mean = min(max(s.sum() / n.sum(), 1e-4), 1 - 1e-4)
        within = mean * (1 - mean)
        between = max(((s * s / n).sum() - n.sum() * mean**2 - (len(n) - 1) * within) / max(n.sum() - (n * n).sum() / n.sum(), 1.0), within / 200)
        return mean, max(within / between - 1, 1.0)

    odds = lambda x: np.log(x / (1 - x))
    clip = lambda x: min(max(x, 1e-4), 1 - 1e-4)
    mean, of_hosts = prior(list(hosts.values()))
    of_paths = prior(list(paths.values()))[1]
    for r in got.values():
        path = (r.source, "/".join(x for x in (r.source, r.lang) if x is not None))
        top = (sum(hosts[r.source]) + of_hosts * mean) / (len(hosts[r.source]) + of_hosts)
        post = (sum(paths[path]) + of_paths * top) / (len(paths[path]) + of_paths)
        z = r.quality_evidence + 0.3 * (odds(clip(post)) - odds(mean))
        assert r.quality_score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
        assert r.quality_kept == (r.quality_score >= 0.5)


def test_sites_shrink(spark):
    """A site with one bad document moves less than one with many."""
    rows = [("big", "p", 0.01)] * 300 + [("small", "p", 0.01)] + [(f"h{k}", "p", 0.95) for k in range(40) for _ in range(30)]
    got = {r.host: r.shift for r in quality.site_posteriors(Scratch(spark, "t"), spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    assert got["big"] < got["small"] < 0.1
