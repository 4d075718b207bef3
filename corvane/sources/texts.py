"""Readers of line and block formats as column expressions over whole or split text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bench_lines(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark output as (name, unit, value): a line is a name, an iteration count and pairs of value and unit.

    A `pkg:` line gives the package of the lines after it in its file; names are then package.name.
    """
    from pyspark.sql import Window

    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    pkg = F.last(F.when(F.col("line").startswith("pkg:"), F.trim(F.substring("line", 5, 1 << 20))), ignorenulls=True).over(Window.partitionBy("file").orderBy("n"))
    fields = F.split(F.trim("line"), r"\s+")
    rows = lines.withColumn("pkg", pkg).filter(F.col("line").rlike(r"^Benchmark\S*\s+[0-9]+\s+\S+\s+\S+")).select("pkg", fields.alias("f"))
    name = F.regexp_replace(F.col("f")[0], "^Benchmark", "")
    pairs = F.transform(F.sequence(F.lit(2), F.size("f") - 2, F.lit(2)), lambda i: F.struct(F.get("f", i).try_cast("double").alias("value"), F.get("f", i + 1).alias("unit")))
    out = rows.select(F.when(F.col("pkg").isNotNull(), F.concat("pkg", F.lit("."), name)).otherwise(name).alias("name"), F.explode(pairs).alias("p"))
    scale = F.when(F.col("p.unit") == "ns/op", 1e-9).otherwise(1.0)
    unit = F.when(F.col("p.unit") == "ns/op", "sec/op").otherwise(F.col("p.unit"))
    return out.select("name", unit.alias("unit"), (F.col("p.value") * scale).alias("value")).filter("value is not null")


def worktree_blocks(text: DataFrame) -> DataFrame:
    """Blocks of a porcelain listing (value): path, head, branch, bare, detached, locked, prunable and the reasons."""
    blocks = text.select(F.posexplode(F.split(F.trim(F.regexp_replace("value", "\r\n", "\n")), "\n\n+")).alias("pos", "block"))

    def value(key: str) -> Column:
        v = F.trim(F.regexp_extract("block", rf"(?m)^{key} (.*)$", 1))
        return F.when(v != "", v)

    flag = lambda key: F.col("block").rlike(rf"(?m)^{key}( .*)?$")
    out = blocks.select(
        "pos", value("worktree").alias("path"), value("HEAD").alias("head"), F.regexp_replace(value("branch"), "^refs/heads/", "").alias("branch"), F.col("block").rlike("(?m)^bare$").alias("bare"),
        F.col("block").rlike("(?m)^detached$").alias("detached"), flag("locked").alias("locked"), value("locked").alias("locked_reason"), flag("prunable").alias("prunable"), value("prunable").alias("prunable_reason"),
    )
    return out.filter("path is not null")


def config_options(text: DataFrame) -> DataFrame:
    """Options of `name value` lines (value): (pos, name in lower case, value); lines with less than two fields are left out."""
    lines = text.select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"\s+$|^\s+", "")))
    return lines.filter(F.col("line").rlike(r"^\S+\s+\S")).select("pos", F.lower(F.regexp_extract("line", r"^(\S+)", 1)).alias("name"), F.regexp_extract("line", r"^\S+\s+(.*)$", 1).alias("value"))


def checksum_for(text: Column, asset: str) -> Column:
    """The digest of the first line of a checksum file that names the asset, in lower case; null without."""
    fields = F.transform(F.split(text, "\n"), lambda x: F.split(F.regexp_replace(x, r"^\s+|\s+$", ""), r"\s+"))
    named = F.filter(fields, lambda f: (F.size(f) >= 2) & (F.regexp_replace(F.regexp_replace(F.get(f, F.lit(1)), r"^\*", ""), r"^\./", "") == asset) & F.get(f, F.lit(0)).rlike("[0-9a-fA-F]{64}"))
    return F.lower(F.regexp_extract(F.get(F.get(named, F.lit(0)), F.lit(0)), "([0-9a-fA-F]{64})", 1))


def runtime_records(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """Records of <prefix>.<pid>.json files whose name and content agree on the pid and that have an address, oldest first."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "pid long, address string, started_at timestamp").alias("r"), F.regexp_extract(F.input_file_name(), rf"{prefix}\.([0-9]+)\.json$", 1).try_cast("long").alias("named"))
    return raw.select("r.*", "named").filter("pid = named and coalesce(address, '') <> ''").drop("named").orderBy("started_at", "pid")
