"""Byte-pair encoding by longest tokens that fit the one before, with steps back, and decoding.

A word's encoding is the only sequence of tokens that spells it in which every two neighbours are compatible, which
their merge trees decide. It is sought from the left, longest token first; a place from which nothing fits the one
encoding of what stands before it is never tried again, so a word of n bytes costs at most n places of a few tests
each, however long it is.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.shared import Memo, bound_batches, held

#: Words and chunks that one Python worker remembers by default, each in two generations (about 1.4 KB for each of them
#: in all), and pairs of tokens whose compatibility it remembers.
MEMO_WORDS, MEMO_PAIRS = 200_000, 200_000
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"\s+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PrefixBpe:
    """Encoder and decoder for one vocabulary file in the tokenizers library's JSON form."""

    def __init__(self, spec: str, memo_words: int = MEMO_WORDS):
        spec = json.loads(spec)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        name = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.name = name | {i: t for t, i in self.special.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: of a merged token: its rank and halves; of a pair of tokens: the rank at which they merge
        self.rank, self.left, self.right, self.pair = {}, {}, {}, {}
        for r, (x, y) in enumerate(merges):
            a, b, t = vocab[x], vocab[y], vocab[x + y]
            self.pair[a << 32 | b] = r
            if t not in self.rank:
                self.rank[t], self.left[t], self.right[t] = r, a, b
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + self.suffix] for s in symbols]
        #: tokens by the bytes they spell, as Latin-1: those that end no word, and those that end one
        self.within = {chr(c): i for c, i in enumerate(self.inner)}
        self.ending = {chr(c): i for c, i in enumerate(self.final)}
        inside = {i: s for s, i in self.within.items()}
        at_end = {i: s for s, i in self.ending.items()} if self.suffix else inside
        for t in sorted(self.rank, key=self.rank.__getitem__):
            x, y = self.left[t], self.right[t]
            if y in inside:
                inside[t] = inside[x] + inside[y]
                self.within.setdefault(inside[t], t)
            else:
                at_end[t] = inside[x] + at_end[y]
                self.ending.setdefault(at_end[t], t)
        if not self.suffix:
            self.ending = self.within
        self.most = max(map(len, self.ending))
        #: of the first two bytes of tokens within a word: the length of the longest that begins with them
        self.reach: dict[str, int] = {}
        for s in self.within:
            if len(s) > self.reach.get(s[:2], 1):
                self.reach[s[:2]] = len(s)
        self.fits: dict[int, bool] = {}
        self.ends: dict[int, list] = {}
        self.starts: dict[int, list] = {}
        special = "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True))
        self.split_special = re.compile(f"({special})") if special else None
        pre = spec["pre_tokenizer"]
        parts = pre["pretokenizers"] if pre["type"] == "Sequence" else [pre]
        self.words = regex.compile(next(p["pattern"]["Regex"] for p in parts if p["type"] == "Split"))
        self.of_word, self.of_chunk = Memo(self._word, memo_words), Memo(self._chunk, memo_words)

    def _edge(self, t: int, half: dict[int, int], held: dict[int, list]) -> list[tuple[int, float]]:
        """The tokens at one edge of t's merge tree, each with the rank at which it is merged away inside t."""
        out = held.get(t)
        if out is None:
            held[t] = out = [(t, float("inf"))]
            while t in self.rank:
                until, t = self.rank[t], half[t]
                out.append((t, until))
        return out

    def compatible(self, x: int, y: int) -> bool:
        """Whether x and y stand side by side in an encoding: no merge across their border comes before those inside.

        Of equal ranks the one further left comes first: x's own before the border's, the border's before y's.
        """
        if len(self.fits) > MEMO_PAIRS:
            self.fits.clear()
        fits = self.fits[x << 32 | y] = self._compatible(x, y)
        return fits

    def _compatible(self, x: int, y: int) -> bool:
        pair, starts = self.pair.get, self._edge(y, self.left, self.starts)
        for a, ua in self._edge(x, self.right, self.ends):
            for b, ub in starts:
                r = pair(a << 32 | b)
                if r is not None and r < ua and r <= ub:
                    return False
        return True

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one word."""
        s, n, most = word.decode("latin-1"), len(word), self.most
        within, ending, reach, fits = self.within.get, self.ending.get, self.reach.get, self.fits
        out: list[int] = []
        starts: list[int] = []
        dead: set[int] = set()  # places at which no token fits what stands before
        i, end, x = 0, n, -1  # the next token starts at i and ends at `end` at most, x stands before it
        while i < n:
            found = False
            if end == n:
                end = n - 1
                if n - i <= most and (t := ending(s[i:])) is not None:
                    ok = x < 0 or fits.get(x << 32 | t)
                    if ok or ok is None and self.compatible(x, t):
                        out.append(t)
                        return out
            for j in range(min(end, i + reach(s[i : i + 2], 1)), i, -1):
                if (t := within(s[i:j])) is not None and j not in dead:
                    ok = x < 0 or fits.get(x << 32 | t)
                    if ok or ok is None and self.compatible(x, t):
                        found = True
                        break
            if found:
                out.append(t)
                starts.append(i)
                i, end, x = j, n, t
            else:
                dead.add(i)
                out.pop()
                end, i = i - 1, starts.pop()
                x = out[-1] if out else -1
        return out

    def _word(self, word: str) -> tuple[str, str]:
        ids = self.encode_word(word.encode("utf-8", "surrogatepass"))
        return " ".join(map(str, ids)), self.decode(ids)

    @staticmethod
    def normalise(chunk: str) -> str:
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
            if "Σ" in chunk:
                return "".join(map(str.lower, chunk))  # character by character: no final sigma
        return chunk.lower()

    def _chunk(self, chunk: str) -> tuple[str, str]:
        """Of what stands between white space: the ids and the tokens, joined by spaces."""
        words = [self.of_word[w] for w in self.words.findall(self.normalise(chunk))]
        return " ".join([w[0] for w in words]), " ".join([w[1] for w in words])

    def encode(self, text: str) -> tuple[int, str, str]:
        """(number of ids, the decimal ids joined by a space, the decoded text) of a whole text."""
        get, got = self.of_chunk.__getitem__, []
        parts = self.split_special.split(text) if self.split_special else [text]
        for k, part in enumerate(parts):
            if k % 2:
                got.append((str(self.special[part]), part))
            elif _ODD_SPACE.search(part):
                got += [x for x in map(get, filter(None, _SPACE.split(part))) if x[0]]
            else:
                got += map(get, part.split())
        if not got:
            return 0, "", ""
        of_ids, of_tokens = zip(*got, strict=True)
        ids = " ".join(of_ids)
        return ids.count(" ") + 1 if ids else 0, ids, " ".join(of_tokens)

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings, special ones too, joined by a space, as this vocabulary has no decoder of its own."""
        return " ".join(map(self.name.__getitem__, ids))


def model(spec: str, memo_words: int = MEMO_WORDS) -> PrefixBpe:
    """One model for each vocabulary in a worker process."""
    return held(("bpe", memo_words, hashlib.sha256(spec.encode("utf-8", "surrogatepass")).digest()), lambda: PrefixBpe(spec, memo_words))


def encode_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, ids: bool = False, decoded: bool = False, memo_words: int = MEMO_WORDS) -> DataFrame:
    """Encode and decode every whole text; no shuffle.

    docs(doc_id, text, ...): a null text is empty and an empty one has no ids; other columns are ignored, each
    row gives a row, also one with a null doc_id, which stays null. Returns doc_id, n_tokens, ids_sha256 (of the decimal
    ids joined by a space) and decoded_sha256 (of the decoded text), with ids=True also the ids (array<int>) and with
    decoded=True the decoded text. memo_words bounds what a worker remembers; results don't depend on it.
    """
    from pathlib import Path

    bound_batches(spark)
    spec = spark.sparkContext.broadcast(Path(tokenizer_path).read_text())  # the vocabulary: 2 MB whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(spec.value, memo_words)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch.slice(i, 64)
                got = [m.encode(t.as_py() or "") for t in part.column(1)]
                cols = [part.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([sha(g[1]) for g in got], pa.string()), pa.array([sha(g[2]) for g in got], pa.string())]
                if ids:
                    of_text = [np.array(g[1].split(), np.int32) for g in got]
                    offsets = np.concatenate(([0], np.cumsum([len(x) for x in of_text]))).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(of_text))))
                if decoded:
                    cols.append(pa.array([g[2] for g in got], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
