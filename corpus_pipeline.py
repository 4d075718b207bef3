"""A corpus from raw documents: five stages, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, decontam, langid, minhash, quality
from corvane.llm.entries import table, tokenizer
from corvane.llm.shared import Scratch, fresh


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, null texts too, and those whose language the calibrated model rejects.

    Repeated rows and null ids stay; without labelled rows nothing with a letter is rejected; columns may have any name.
    """
    model = langid.fit_languages(docs)
    passed, lang, score = (fresh(docs.columns, c) for c in ("passed", "lang_found", "lang_score"))
    out = langid.identify(spark, docs, model, pred=lang, score=score, passed=passed)
    return out.filter(F.col(passed)).select(docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose posterior says that they are junk or toxic.

    Null texts are judged as empty ones; null sources and languages are sites of their own; repeated rows and null ids
    stay or go each by its own text. Without labels of both classes all stay.
    """
    evidence = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    out = quality.judge(spark, docs, evidence, F.col("source"), F.concat_ws("/", "source", "lang"))
    return out.filter("quality_kept").select(docs.columns)  # the columns of documents have none of judge's three names


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies (five words, similarity 0.8).

    Null and blank texts are copies of nothing and stay; rows with a null doc_id can't be named in a group and go; of
    rows with the same doc_id all stay or all go, as the one with the largest set decides.
    """
    return minhash.keep_firsts(docs, minhash.near_duplicates(spark, docs, num=80, den=100))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of texts and drops documents that are mostly made of them; n_chars follows.

    Null texts stay null; every row is judged by its own text.
    """
    out = decontam.remove_hits(spark, docs, table(spark, sf_dir, "benchmark"))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's text; a row for each row, a null text has none."""
    return bpe.encode_documents(spark, docs, tokenizer("word_bpe_49k.json"), ids=True, memo_words=20_000).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("language", language), ("quality", good_quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("encode", encode)]
#: A trained model decides in the first two stages, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name)
        if hasattr(before, "corvane_path"):
            scratch.drop(before)
    return docs
