"""Token ids in ORC: one row per document, stripes of bounded size, integer run-length encoding.

The file format is that of Spark's own ORC writer. A row holds doc_id, the number of ids and the ids as
array<int>, which ORC packs by its integer run-length encoding. Stripes are read in parallel (one split each), row indexes and Bloom filters on doc_id
let a reader skip stripes and row groups that can't hold a document. Files hold ascending, disjoint ranges
of doc_id; an index table beside them has each file's smallest doc_id and its number of ids, so that a
document's place in the whole sequence is the sum over the files before its own plus its place in the file.
"""

from __future__ import annotations

import re
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.bpe import byte_symbols
from corvane.llm.shared import Memo, bound_batches, held

#: Words whose ids one Python worker remembers, in two generations.
MEMO_WORDS = 500_000
#: A text with one of these may hold a special token, or white space on which libraries differ.
_WHOLE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
_WIDE = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A space after which no word starts: what stands before it and what follows belong together.
_LOOSE = ("  ", " \n", " \t", " \r", " \v", " \f")
_WIDE_LOOSE = re.compile(f" [{_WIDE}]")
_BEFORE_WORD = re.compile(r"(?= \S)")
_ROW = "doc_id long, n_ids long, ids array<int>"


def load_tokenizer(spec: str):
    """The tokenizer of a tokenizers JSON document."""
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec)


class PieceEncoder:
    """Encodes whole texts with a byte-level tokenizer; words that recur are encoded once for a worker.

    Such a tokenizer starts a new word at every space that a non-space follows, whatever stands before, so the
    ids of a text are those of the pieces between such places. A new word is cut into pretokens by the tokenizer's
    own pattern (a fixed value) and each is given to the library's model. What stands before the first word, and texts
    in which special tokens may stand, are given to the tokenizer as they are.
    """

    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def __init__(self, spec: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = load_tokenizer(spec)
        self.tokenize = self.tokenizer.model.tokenize
        self.symbols = str.maketrans({chr(b): c for b, c in enumerate(byte_symbols())})
        self.marks = {c: self._ids(c) for c in string.punctuation}
        self.words = Memo(self._word, MEMO_WORDS)  # by the word after a space, which isn't in the key

    def _ids(self, pretoken: str) -> bytes:
        plain = pretoken.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.symbols)
        return array("I", [t.id for t in self.tokenize(plain)]).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            return self._ids(" " + word)
        if (mark := self.marks.get(word[-1:])) and word[:-1].isalpha():
            return self._ids(" " + word[:-1]) + mark
        return b"".join(map(self._ids, self.PATTERN.findall(" " + word)))

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    @staticmethod
    def cut(text: str) -> tuple[str, list[str]]:
        """What stands before the first word that follows a space, and those words; rejoined by spaces they are the text."""
        if any(map(text.__contains__, _WHOLE)):
            return text, []
        if text.endswith(" ") or any(map(text.__contains__, _LOOSE)) or not text.isascii() and _WIDE_LOOSE.search(text):
            first, *rest = _BEFORE_WORD.split(text)
            return first, [w[1:] for w in rest]
        first, *rest = text.split(" ")
        return first, rest

    def __call__(self, text: str) -> bytes:
        """The ids of a text as unsigned 32-bit integers."""
        first, rest = self.cut(text)
        return self._encode(first) + b"".join(map(self.words.__getitem__, rest))


def encoder(spec: str) -> PieceEncoder:
    """One encoder for each tokenizer in a worker process."""
    return held(("pieces", spec), lambda: PieceEncoder(spec))


def write_tokens(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int, path: str, files: int | None = None, stripe_mb: int = 16) -> DataFrame:
    """Encode every whole text, append end_id and write the files under path in ascending doc_id order.

    docs(doc_id, text, ...): null and empty texts become the end id alone, rows with a null doc_id are left out,
    rows with the same doc_id are all written, those of equal ids side by side; other columns are ignored.
    Returns the index (path, first_id, last_id, n_docs, n_ids, start), one row for each file.
    """
    from pathlib import Path

    bound_batches(spark)
    spec = spark.sparkContext.broadcast(Path(tokenizer_path).read_text())  # the vocabulary: 2 MB whatever the corpus
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(spec.value), np.array([end_id], np.uint32).tobytes()
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                ids = [encode(t or "") + end for t in part.column(1).to_pylist()]
                counts = np.array([len(x) // 4 for x in ids], np.int64)
                offsets = np.concatenate(([0], counts.cumsum())).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), lists], names=["doc_id", "n_ids", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    tokens = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, _ROW)
    (tokens.write.option("compression", "zstd").option("orc.stripe.size", stripe_mb << 20).option("orc.row.index.stride", 1000).option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(f"{path}/ids"))
    sizes = spark.read.schema(_ROW).orc(f"{path}/ids").groupBy(F.input_file_name().alias("path")).agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n_docs"), F.sum("n_ids").alias("n_ids"))
    # one row for each file: the only ordered pass over all of them
    before = F.sum("n_ids").over(Window.orderBy("first_id", "path").rowsBetween(Window.unboundedPreceding, -1))
    sizes.select("*", F.coalesce(before, F.lit(0)).alias("start")).write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the files (doc_id, n_ids, ids), by stripes in parallel; a filter on doc_id prunes by their metadata."""
    return spark.read.schema(_ROW).orc(f"{path}/ids")


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files.

    start counts the ids of all documents before it in the whole sequence. ids_crc32 is the unsigned crc32 of
    the ids as little-endian unsigned 32-bit integers. An empty corpus has no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ids, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(ids[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "path", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).select("doc_id", F.input_file_name().alias("path"), "ids").mapInArrow(run, "doc_id long, path string, n_tokens long, ids_crc32 long")
    index = spark.read.parquet(f"{path}/index").select("path", F.col("start").alias("file_start"))
    within = Window.partitionBy("path").orderBy("doc_id", "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(index, "path").select("doc_id", (F.col("file_start") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("start"), "n_tokens", "ids_crc32")
