"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' word sequences go into one automaton, each as a string of its own. A document's words stream through it;
after each word the automaton's state and the length of the longest match that ends there are known. A window (ten
consecutive words of an item, or a whole shorter item) ends at a word exactly if the longest match there is at least
as long and, for a shorter item, the item itself is a suffix of the match. Hit words are marked; spans of them that
exceed a length, and documents that exceed a coverage, are removed.

Items are sent to the executors in lots of bounded size, each in automata of bounded size. Documents don't move; a
benchmark of more than one lot is a pass over them for each lot.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.shared import Scratch, bound_batches, fresh, held

WINDOW = 10
#: Words of the items in one automaton, and the most that are sent to the executors in one go.
SHARD_WORDS, SENT_WORDS = 200_000, 2_000_000
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def item_words(text: str | None) -> list[str]:
    """Normalised words: A-Z lower-cased, runs of ASCII digits, letters and anything beyond ASCII."""
    return _WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower()) if text else []


class ItemAutomaton:
    """A generalised suffix automaton over word numbers; next[s] maps a word to a state."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.window = window
        ends: list[tuple[int, str, int]] = []
        for item, words in items:
            last = 0
            for c in words:
                last = self._extend(last, c)
            if 0 < len(words) < window:
                ends.append((last, item, len(words)))
        #: of each state that holds windows, the items they are from
        self.full: dict[int, set[str]] = {}
        for item, words in items:
            if len(words) < window:
                continue
            s, matched = 0, 0
            for c in words:
                s, matched = self.next[s][c], matched + 1
                if matched >= window:
                    self.full.setdefault(self._at(s, window), set()).add(item)
        self.short: dict[int, tuple[int, set[str]]] = {}
        for s, item, n in ends:
            self.short.setdefault(s, (n, set()))[1].add(item)
        # the nearest state on the way of suffix links, itself included, at which a short item ends
        self.nearest = [-1] * len(self.size)
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            self.nearest[s] = s if s in self.short else self.nearest[self.link[s]]
        self.least = min([window, *(n for _, _, n in ends)]) if items else window

    def _at(self, s: int, length: int) -> int:
        """The state of the suffix of that length."""
        while self.size[self.link[s]] >= length:
            s = self.link[s]
        return s

    def _split(self, p: int, q: int, c: int) -> int:
        """A copy of q for its strings up to one longer than p's."""
        r = len(self.size)
        self.next.append(dict(self.next[q]))
        self.size.append(self.size[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = r
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = r
            p = self.link[p]
        return r

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, q, c)
        new, p = len(self.size), last
        self.next.append({})
        self.size.append(self.size[last] + 1)
        self.link.append(0)
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, c)
        return new

    def stream(self, ids: list[int], hit: np.ndarray, items: set[str]) -> None:
        """Mark the hit words of a document and add the items whose windows occur; words no item has are -1."""
        nxt, link, size, nearest, window = self.next, self.link, self.size, self.nearest, self.window
        s = matched = 0
        for i, c in enumerate(ids):
            if c < 0:
                s = matched = 0
                continue
            to = nxt[s].get(c)
            while to is None and s:
                s = link[s]
                matched = size[s]
                to = nxt[s].get(c)
            if to is None:
                continue
            s, matched = to, matched + 1
            if matched >= window:
                hit[i - window + 1 : i + 1] = True
                items |= self.full.get(self._at(s, window), set())
            if nearest[s] >= 0:
                at = nearest[s]
                if matched < size[at]:
                    at = nearest[link[at]]
                first = True
                while at >= 0:
                    n, found = self.short[at]
                    if first:
                        hit[i - n + 1 : i + 1] = True
                        first = False
                    items |= found
                    at = nearest[link[at]]


@dataclass
class Shards:
    """Automata over bounded shards of the items, with the numbers of their words."""

    numbers: dict[str, int]
    automata: list[ItemAutomaton]

    @staticmethod
    def build(items: list[tuple[str, list[str]]], window: int) -> Shards:
        numbers: dict[str, int] = {}
        shards, now, held = [], [], 0
        for item, words in items:
            now.append((item, [numbers.setdefault(w, len(numbers)) for w in words]))
            held += len(words)
            if held >= SHARD_WORDS:
                shards.append(now)
                now, held = [], 0
        return Shards(_Numbers(numbers), [ItemAutomaton(x, window) for x in [*shards, now] if x])

    def scan(self, words: list[str], hit: np.ndarray, items: set[str]) -> None:
        ids = list(map(self.numbers.__getitem__, words))
        for a in self.automata:
            if len(words) >= a.least:
                a.stream(ids, hit, items)


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        return -1


def load_items(benchmark: DataFrame) -> Iterator[list[tuple[str, list[str]]]]:
    """The normalised items of benchmark(item_id, text, ...) in lots of at most SENT_WORDS words (or one item), one at a time.

    Items without words and null texts are left out, a null item_id is the item ''. The benchmark streams to the
    driver one partition at a time, and the driver holds one lot.
    """
    lot, words_held = [], 0
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("string").alias("t")).orderBy("i", "t").toLocalIterator():
        words = item_words(r.t)
        if lot and words_held + len(words) > SENT_WORDS:
            yield lot
            lot, words_held = [], 0
        if words:
            lot.append((r.i, words))
            words_held += len(words)
    if lot:
        yield lot


_FOUND = "n_words long, n_hit long, hit binary, items array<string>"


def _scanned(spark: SparkSession, docs: DataFrame, lot: list, window: int, name: str, before: bool) -> DataFrame:
    """docs with the column name (_FOUND) for one lot, added to what it has of the lots before."""
    sent = spark.sparkContext.broadcast(lot)  # SENT_WORDS words at most
    key = hashlib.sha256(repr((window, lot)).encode("utf-8", "surrogatepass")).hexdigest()

    def run(series: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        shards = held(("items", key), lambda: Shards.build(sent.value, window))
        for texts, was in series:
            n, h, bits, names = [], [], [], []
            for t, old in zip(texts, was, strict=True):
                words, old = item_words(t.as_py()), old.as_py()
                hit, items = np.zeros(len(words), bool), set()
                if old and old["n_hit"]:
                    hit, items = np.unpackbits(np.frombuffer(old["hit"], np.uint8), count=len(words)).astype(bool), set(old["items"])
                shards.scan(words, hit, items)
                n.append(len(words))
                h.append(int(np.count_nonzero(hit)))
                bits.append(np.packbits(hit).tobytes() if h[-1] else b"")
                names.append(sorted(items))
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(bits, pa.binary()), pa.array(names, pa.list_(pa.string()))], names=["n_words", "n_hit", "hit", "items"])

    old = F.col(name) if before else F.lit(None).cast(f"struct<{_FOUND.replace(' ', ':').replace(',:', ',')}>")
    return docs.withColumn(name, F.arrow_udf(run, _FOUND)(F.col("text").cast("string"), old))


def marked(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, str]:
    """docs with a struct of what was found in each text, and the name of that column.

    A benchmark of one lot is applied as the result is read. More lots are a job each: docs with what was found so far
    are written to the shared folder and read again, so that no task, executor or driver holds more than one lot.
    """
    bound_batches(spark)
    name, lots = fresh(docs.columns, "found"), load_items(benchmark)
    out, scratch, last = _scanned(spark, docs, next(lots, []), window, name, False), None, None
    for lot in lots:
        scratch = scratch or Scratch(spark, "hits")
        kept = scratch.keep(out, "lot")
        if last is not None:
            scratch.drop(last)
        last, out = kept, _scanned(spark, kept, lot, window, name, True)
    return out, name


def hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of docs(doc_id, text, ...): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts words inside an occurrence of a window, n_items the items with occurring windows, items_sha256 is the
    lower-case hex digest of their ids, sorted as strings and joined by commas. A null text has no words; an empty
    benchmark hits nothing; repeated items count as one id; repeated rows give a row each; other columns are ignored.
    """
    out, name = marked(spark, docs.select("doc_id", "text"), benchmark, window)
    x = F.col(name)
    return out.select("doc_id", x["n_words"].alias("n_words"), x["n_hit"].alias("n_hit"), F.size(x["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(x["items"], ","), 256).alias("items_sha256"), (x["n_hit"] > 0).alias("contaminated"))


def remove_hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, longest_span: int = 0, coverage: float = 0.5) -> DataFrame:
    """docs without benchmark passages: spans of more than longest_span hit words are cut from the text (words of it and
    what stands between them), documents of which more than coverage of the words are hit go. Other columns stay, whatever
    their names; null texts and texts without hits stay as they are.
    """
    out, name = marked(spark, docs, benchmark, window)
    x = F.col(name)

    def run(series: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, bits, counts in series:
            cut = []
            for t, hit, n in zip(texts, bits, counts, strict=True):
                cut.append(_cut(t.as_py(), np.unpackbits(np.frombuffer(hit.as_py(), np.uint8), count=n.as_py()).astype(bool), longest_span) if t.is_valid else None)
            yield pa.array(cut, pa.string())

    out = out.filter(x["n_hit"] <= coverage * x["n_words"])
    clean = F.arrow_udf(run, "string")(F.when(x["n_hit"] > 0, F.col("text").cast("string")), x["hit"], x["n_words"])
    return out.withColumn("text", F.coalesce(clean, "text")).drop(name)


def _cut(text: str, hit: np.ndarray, longest: int) -> str:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    spans = [(a, b) for a, b in edges.reshape(-1, 2) if b - a > longest]
    where = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : where[a][0]])
        at = where[b - 1][1]
    return "".join([*out, text[at:]])
