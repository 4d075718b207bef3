"""Language identification: averaged hashed subword embeddings with a linear softmax.

A word gives a bucket of its own and those of its character 1- to 4-grams, with a mark at its start and end. A text
is the average of the embeddings of all its words' buckets, followed by a linear layer and a softmax; both
matrices are trained by stochastic gradient descent in numpy. A temperature fitted on labelled texts that the
training leaves out makes the probabilities honest, and on them the rejection threshold is set.

Only letters count: a word is a run of them and their marks between any other characters. The buckets of a whole
text are computed at once from its code points, so a text costs the same whether its words are common or not. As
the model is linear up to the softmax, a prediction needs only the counts of buckets and the product of the matrices.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.shared import bound_batches, fresh, held

#: The embedding table: buckets, dimensions.
BUCKETS, DIM = 1 << 15, 16
_SHIFT = np.uint32(32 - (BUCKETS - 1).bit_length())
_STEP, _SPREAD = np.uint32(0x01000193), np.uint32(0x9E3779B1)


@cache
def letters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point whether it is a letter, and whether it is a letter or a mark."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    letter = np.array([k == "L" for k in kinds])
    return letter, letter | np.array([k == "M" for k in kinds])


def text_buckets(text: str) -> np.ndarray:
    """The buckets of a whole text with repetitions; empty if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter, in_word = letters()
    if not letter[codes].any():
        return np.empty(0, np.uint32)
    inside = in_word[codes]
    # one mark, 0, between words and at both ends
    codes = np.concatenate(([0], np.where(inside, codes, 0), [0])).astype(np.uint32)
    keep = codes != 0
    keep[0] = True
    keep[1:] |= codes[:-1] != 0
    codes = codes[keep]
    word = codes != 0
    gram, out = codes, []
    for n in (1, 2, 3, 4):
        if n > 1:
            gram = gram[:-1] * _STEP + codes[n - 1 :]
        # marks stand at the ends of a gram only
        fits = word if n == 1 else word[:-1] | word[1:] if n == 2 else np.logical_and.reduce([word[k : len(word) - n + 1 + k] for k in range(1, n - 1)])
        out.append(gram[fits] + np.uint32(n))
    starts = np.flatnonzero(~word[:-1]) + 1
    ends = np.append(starts[1:], len(codes))
    at = np.arange(starts[0], len(codes)) - np.repeat(starts, ends - starts)
    whole = (codes[starts[0] :] ^ (at.astype(np.uint32) * _SPREAD)) * _STEP
    out.append(np.add.reduceat(whole ^ (whole >> np.uint32(15)), starts - starts[0], dtype=np.uint32) + np.uint32(5))
    h = np.concatenate(out)
    return ((h ^ (h >> np.uint32(15))) * _SPREAD) >> _SHIFT


@dataclass
class LanguageModel:
    """weights [BUCKETS, languages]: embeddings times linear layer; a null score is none."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, logits: np.ndarray) -> np.ndarray:
        z = (logits + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)


def average(text: str, weights: np.ndarray) -> np.ndarray | None:
    """The average of the bucket rows of a whole text; None if it has no letter."""
    b = text_buckets(text)
    if not len(b):
        return None
    total = weights[b].sum(axis=0) if len(b) < BUCKETS // 8 else np.bincount(b, minlength=BUCKETS) @ weights
    return total / len(b)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and each one's share."""
    counts = np.bincount(text_buckets(text))
    b = np.flatnonzero(counts)
    return b, (counts[b] / max(1, counts.sum())).astype(np.float32)


def train(texts: list[str], langs: list[str], epochs: int = 6, rate: float = 0.5, seed: int = 3, reject: float = 0.0005) -> LanguageModel:
    """Fit on texts and their languages; every fifth text calibrates and isn't trained on.

    reject is the share of calibration texts with a right answer that may score below the threshold, which is 0.5
    at most. With one language or none the softmax has a single class or none, and the threshold is 0.
    """
    names = sorted(set(langs))
    if len(names) < 2:
        return LanguageModel(names or ["und"], np.zeros((BUCKETS, max(1, len(names)))), np.zeros(max(1, len(names))), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    y = np.array([names.index(x) for x in langs])
    bags = [bag(t) for t in texts]
    fit, held = order[len(order) // 5 :], order[: len(order) // 5]
    emb, lin, bias = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.1, (DIM, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        for k in rng.permutation(fit):
            b, n = bags[k]
            if not len(b):
                continue
            rows = emb[b]
            h = n @ rows
            z = h @ lin + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            g = lin @ p
            lin -= lr * np.outer(h, p)
            bias -= lr * 0.1 * p
            rows -= np.outer(n, lr * len(b) ** 0.5 * g).astype(np.float32)
            emb[b] = rows
    weights = emb.astype(np.float64) @ lin
    raw = np.array([bags[k][1] @ weights[bags[k][0]] + bias for k in held if len(bags[k][0])]).reshape(-1, len(names))
    truth = np.array([y[k] for k in held if len(bags[k][0])], int)
    if not len(truth):
        return LanguageModel(names, weights, bias, 1.0, 0.0)

    def loss(temp: float) -> float:
        z = raw / temp
        z -= z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]))

    temp = min(np.geomspace(0.25, 4, 33), key=loss)
    model = LanguageModel(names, weights, bias, float(temp), 0.0)
    p = model.scores(raw - bias)
    right = p[np.arange(len(p)), truth][p.argmax(axis=1) == truth]
    model.threshold = float(min(0.5, np.quantile(right, reject))) if len(right) else 0.0
    return model


def fit_languages(docs: DataFrame, most: int = 2000) -> LanguageModel:
    """Train on at most `most` rows of docs(doc_id, text, lang) with a text and a language.

    The sample is bounded (`most` is its size, whatever the corpus) and spread over the table by a hash of doc_id;
    it is the only thing that comes to the driver.
    """
    bound_batches(docs.sparkSession)
    rows = docs.filter("text is not null and lang is not null and doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    picked = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # one row for each id: what comes to the driver stays `most` rows however often an id is repeated
    sample = rows.join(F.broadcast(picked), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("x")).select("doc_id", "x.*").collect()
    sample.sort(key=lambda r: r.doc_id)
    return train([r.text for r in sample], [r.lang for r in sample])


def identify(spark: SparkSession, docs: DataFrame, model: LanguageModel, pred: str = "lang_pred", score: str = "score", passed: str | None = None) -> DataFrame:
    """docs with the predicted language and its probability; no shuffle, whole texts.

    A null text and one without a letter are `und` with score 0. passed names a boolean column for the calibrated
    rejection (false: `und`, or a score below the model's threshold). Only `text` is read; the other columns stay
    as they are, whatever their names, and one of the new names takes the place of an old one.
    """
    bound_batches(spark)
    key = hashlib.sha256(model.weights.tobytes() + repr((model.languages, model.bias.tolist(), model.temperature)).encode()).hexdigest()
    sent = spark.sparkContext.broadcast(model)  # BUCKETS x languages numbers, whatever the corpus

    def run(series: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = held(("language", key), lambda: sent.value)
        for column in series:
            names, scores = [], []
            for i in range(0, len(column), 512):
                sums = [average(t, m.weights) if t else None for t in column.slice(i, 512).to_pylist()]
                p = m.scores(np.array([np.zeros(len(m.languages)) if x is None else x for x in sums]))
                names += ["und" if x is None else m.languages[k] for x, k in zip(sums, p.argmax(axis=1), strict=True)]
                scores += [0.0 if x is None else float(y) for x, y in zip(sums, p.max(axis=1), strict=True)]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["pred", "score"])

    found = F.arrow_udf(run, "pred string, score double")(F.col("text").cast("string"))
    name = fresh([*docs.columns, pred, score, passed or ""], "language")
    out = docs.select(*docs.columns, found.alias(name))
    new = {pred: F.col(f"{name}.pred"), score: F.col(f"{name}.score")}
    if passed:
        new[passed] = (F.col(f"{name}.pred") != "und") & (F.col(f"{name}.score") >= model.threshold)
    return out.withColumns(new).drop(name)
