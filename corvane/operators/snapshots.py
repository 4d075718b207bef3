"""Snapshots: manifests, attachment lists, audits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import path_problem

SNAPSHOT_ID = r"^\d{8}T\d{6}Z-[0-9a-f]{32}$"


def snapshot_id(created: Column, body: Column) -> Column:
    """Time in seconds, then 32 hex digits of the SHA-256 of the manifest's JSON with a blank id."""
    return F.concat(F.date_format(created, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.left(F.sha2(body, 256), F.lit(32)))


def latest(snapshots: DataFrame) -> DataFrame:
    """The last snapshot with a well-formed id; ids begin with their time."""
    return snapshots.filter(F.col("snapshot_id").rlike(SNAPSHOT_ID)).orderBy(F.desc("snapshot_id")).limit(1)


def next_created(now: Column, parent: Column) -> Column:
    """now in whole seconds, or a second after the parent if that isn't later."""
    whole = F.date_trunc("second", now)
    return F.when(parent.isNull() | (whole > parent), whole).otherwise(F.date_trunc("second", parent) + F.expr("INTERVAL 1 SECOND"))


def shrank(parent: DataFrame, current: DataFrame) -> DataFrame:
    """What the parent's lists have and the current ones lack; if there is any, the whole list is written anew."""
    return parent.select("hash").distinct().join(current.select("hash"), "hash", "left_anti")


def capture(refs: DataFrame, seen: DataFrame) -> DataFrame:
    """First appearance of each hash that isn't in the parent's lists, by position."""
    first = refs.groupBy("hash").agg(F.min("pos").alias("pos"), F.min_by("size", "pos").alias("size"))
    return first.join(seen.select("hash"), "hash", "left_anti")


def totals_problems(manifests: DataFrame, refs: DataFrame) -> DataFrame:
    """Snapshots whose count and bytes of distinct attachments aren't what the manifest says."""
    t = refs.select("snapshot_id", "hash", "size").distinct().groupBy("snapshot_id").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    both = manifests.join(t, "snapshot_id", "left").select("snapshot_id", "blobs", "bytes", F.coalesce("n", F.lit(0)).alias("found_blobs"), F.coalesce("b", F.lit(0)).alias("found_bytes"))
    return both.filter("blobs <> found_blobs or bytes <> found_bytes")


def reference_problems(refs: DataFrame, index: DataFrame, sizes: bool = True) -> DataFrame:
    """Problems of every snapshot's references: blobs that no index has, or of another size. All are reported.

    Each distinct blob is looked up once and its verdict goes to all references.
    """
    known = index.select("hash", F.col("raw_len").alias("stored"))
    verdict = refs.select("hash", "size").distinct().join(known, "hash", "left")
    wrong = F.when(F.col("stored").isNull(), "missing").when(F.lit(sizes) & (F.col("stored") != F.col("size")), "size")
    return refs.join(verdict.select("hash", "size", wrong.alias("detail")).filter("detail is not null"), ["hash", "size"]).select("snapshot_id", "hash", "detail")


def folded_key(path: Column) -> Column:
    """What two paths share that a file system may take for one: cleaned, composed (NFC) and in lower case."""

    @F.pandas_udf("string")
    def composed(p: pd.Series) -> pd.Series:
        return p.str.normalize("NFC")

    clean = F.regexp_replace(F.regexp_replace(path, r"/+(?:\./+)*", "/"), r"^(?:\./)+|/\.?$", "")
    return F.lower(composed(clean))


def path_problems(entries: DataFrame, reserved: tuple[str, ...]) -> DataFrame:
    """Unsafe paths and those that collide with another once folded: (path, problem)."""
    folded = entries.select("path", folded_key(F.col("path")).alias("f"))
    clash = folded.groupBy("f").agg(F.count("*").alias("n")).filter("n > 1").select("f", F.lit("collision").alias("c"))
    p = F.coalesce(path_problem(F.col("path"), reserved), F.col("c"))
    return folded.join(clash, "f", "left").select("path", p.alias("problem")).filter("problem is not null")
