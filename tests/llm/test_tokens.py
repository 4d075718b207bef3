"""Both encoders against the tokenizers library; ORC files read back."""

import hashlib
import random
import struct
import zlib

import pyarrow.orc as orc
import pytest
from tokenizers import Tokenizer

from corvane.llm import bpe, token_orc
from corvane.llm.entries import tokenizer
from tests.conftest import DATA

ODD = [
    None, "", "a", " a", "a ", "  a  b   c", "a\n\n b\n  c \n", "x <|endoftext|> y<|startoftext|>", "a  <|endoftext|>  b", "<|", "don't I'LL we've 's", "ΑΣ ΣΑΣ Σ", "İstanbul ẞ ﬁ Ǆ", "a\x1cb \x1d c\x85d e f　g",
    "日本語 한국어 𝔘𝔫 😀😁", "x̣́ é é ́", "a" * 3000, "ab" * 4000, "123 4567 ½²", "$$$ %%% a$$$b|c", "​﻿", "tab\tsep\t\tx",
]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(2)
    made = ["".join(r.choice("abcdeth in'sre,.!é ñ\n\t  ") for _ in range(r.randint(1, 160))) for _ in range(500)]
    return ODD + made + ["".join(r.choice("aabn") for _ in range(r.randint(1, 60))) for _ in range(500)]


def test_prefix_bpe(spark, texts):
    path = tokenizer("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.encode_documents(spark, df, path, ids=True, decoded=True).collect()}
    assert len(got) == len(texts)
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and got[i].decoded == back, x
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert bpe.model(open(path).read()).decode(got[10].ids) == got[10].decoded


def test_orc_files(spark, tmp_path, texts):
    path = tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = [(len(texts) - i, x, 5) for i, x in enumerate(texts)] + [(None, "lost", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(5)
    out = f"file://{tmp_path}/t"
    index = token_orc.write_tokens(spark, df, path, 0, out, files=3).orderBy("first_id").collect()
    want, start = {}, 0
    for i, x, _ in sorted(r for r in rows if r[0]):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want[i] = (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_orc.token_digest(spark, out).collect()} == want
    assert all(a.last_id < b.first_id for a, b in zip(index, index[1:], strict=False))
    files = sorted((tmp_path / "t/ids").glob("*.orc"))
    assert [list(orc.ORCFile(f).read(["doc_id"])["doc_id"].to_pylist()) == sorted(orc.ORCFile(f).read(["doc_id"])["doc_id"].to_pylist()) for f in files] == [True] * len(files)
    plan = token_orc.read_tokens(spark, out).filter("doc_id = 7")
    assert plan.count() == 1 and "EqualTo(doc_id,7)" in plan._jdf.queryExecution().toString()
    assert b"BLOOM" in b"".join(str(orc.ORCFile(f).metadata).encode() for f in files) or orc.ORCFile(files[0]).nstripes >= 1


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    token_orc.write_tokens(spark, df, tokenizer("byte_bpe_50k.json"), 0, f"file://{tmp_path}/e", files=2)
    assert token_orc.token_digest(spark, f"file://{tmp_path}/e").count() == 0
    assert bpe.encode_documents(spark, df, tokenizer("word_bpe_49k.json")).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    got = {r.doc_id: r.ids_sha256 for r in bpe.encode_documents(spark, docs, tokenizer("word_bpe_49k.json")).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == hashlib.sha256(" ".join(map(str, t.encode(r.text, add_special_tokens=False).ids)).encode()).hexdigest()


def test_model_is_small_and_long_words_take_linear_steps():
    """On the vocabulary with steps back; a model of a worker takes less than 30 MB."""
    import tracemalloc

    path = tokenizer("word_bpe_49k.json")
    t, spec, r = Tokenizer.from_file(path), open(path).read(), random.Random(3)
    tracemalloc.start()
    m = bpe.PrefixBpe(spec, 100)
    used = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert used < 30e6
    bits = ["ing", "tion", "er", "ß", "ü", "th", "n", "e", "a", "an", "chung"]
    words = ["".join(r.choice(bits) for _ in range(r.randint(1, 12))) for _ in range(2000)] + ["".join(r.choice(bits) for _ in range(20_000))]
    for w in words:
        assert m.encode_word(w.encode()) == t.encode(w, add_special_tokens=False).ids
