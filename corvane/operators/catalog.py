"""Content-addressed catalogue: deduplication, membership, usage, maintenance selections and consistency.

Relations: members(hash, original_hashes), entries(hash, pack_id, offset, stored_len, raw_len, flags, crc32c),
packs(pack_id, entry_count, stored_bytes, created_at), loose(hash, ...). Everything is a join or an aggregation on
hash or pack_id; membership tests are semi and anti joins, so that no side is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import is_digest

#: Limits and container sizes in bytes.
MAX_BLOB, MAX_CONTAINER, MAX_FOOTER, MAX_ENTRIES = 64 << 20, 128 << 20, 8 << 20, 100_000
FOOTER_HEAD, FOOTER_ENTRY, TRAILER, FIRST_OFFSET = 4, 61, 40, 6
MIN_DEAD = 8 << 20


def dedup(blobs: DataFrame, known: DataFrame, order: str = "pos") -> DataFrame:
    """The first blob of each hash that isn't known yet."""
    return blobs.groupBy("hash").agg(F.min_by(F.struct(*[c for c in blobs.columns if c != "hash"]), order).alias("b")).select("hash", "b.*").join(known.select("hash"), "hash", "left_anti")


def last_index_wins(entries: DataFrame) -> DataFrame:
    """Union of index files: of entries with the same hash that of the largest index_id."""
    rest = [c for c in entries.columns if c != "hash"]
    return entries.groupBy("hash").agg(F.max_by(F.struct(*rest), "index_id").alias("e")).select("hash", "e.*")


def list_unpacked(candidates: DataFrame, members: DataFrame, entries: DataFrame) -> DataFrame:
    """Candidates that are members and in no pack yet."""
    return candidates.join(members.select("hash"), "hash", "left_semi").join(entries.select("hash"), "hash", "left_anti")


def unreferenced(entries: DataFrame, members: DataFrame) -> DataFrame:
    return entries.join(members.select("hash"), "hash", "left_anti")


def resolve(requests: DataFrame, members: DataFrame, entries: DataFrame) -> DataFrame:
    """For each requested hash whether it is a member and, only then, where it is packed."""
    m = members.select("hash", F.lit(True).alias("member")).distinct()
    out = requests.join(m, "hash", "left").join(entries.select("hash", "pack_id", "offset"), "hash", "left")
    is_member = F.coalesce("member", F.lit(False))
    return out.select("hash", is_member.alias("member"), F.when(is_member, F.col("pack_id")).alias("pack_id"), F.when(is_member, F.col("offset")).alias("offset"))


def live_entries(entries: DataFrame, members: DataFrame) -> DataFrame:
    return entries.join(members.select("hash"), "hash", "left_semi")


def usage(packs: DataFrame, live: DataFrame) -> DataFrame:
    """Live count and sizes of every pack; zeros for packs without live entries."""
    u = live.groupBy("pack_id").agg(F.count("*").alias("live"), F.sum("stored_len").alias("live_stored"), F.sum("raw_len").alias("live_raw"), F.max("stored_len").alias("max_stored"), F.max("raw_len").alias("max_raw"))
    names = ["live", "live_stored", "live_raw", "max_stored", "max_raw"]
    return packs.join(u, "pack_id", "left").select(*packs.columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names])


def usage_changed(then: DataFrame, now: DataFrame) -> DataFrame:
    """Packs whose usage isn't what it was at selection time."""
    names = ["live", "live_stored", "live_raw"]
    n = now.select("pack_id", *[F.col(c).alias(f"now_{c}") for c in names])
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"now_{c}"))
    return then.select("pack_id", *names).join(n, "pack_id", "full_outer").filter(~same)


def repack_candidates(used: DataFrame, now: Column, min_age: str = "INTERVAL 24 HOURS", min_dead: int = MIN_DEAD) -> DataFrame:
    """Packs to rewrite: those without live entries, then old ones at most half live with enough dead bytes.

    Half is (entries - 1) / 2 rounded down. `partial` tells the two apart; repack_order ranks them.
    """
    empty = F.col("live") == 0
    sparse = (F.col("live") <= F.floor((F.col("entry_count") - 1) / 2)) & (F.col("created_at") <= now - F.expr(min_age)) & (F.col("stored_bytes") - F.col("live_stored") >= min_dead)
    return used.filter(empty | sparse).withColumn("partial", ~empty)


def repack_order(chosen: DataFrame) -> DataFrame:
    """Adds rank from 0 in the order (partial, created_at, pack_id); candidates are packs, a few rows for each terabyte."""
    return chosen.withColumn("rank", F.row_number().over(Window.orderBy("partial", "created_at", "pack_id")) - 1)


def moves_problems(expected: DataFrame, moves: DataFrame) -> DataFrame:
    """Where moves(hash, source) isn't exactly the set expected(hash, source): omitted, extra or duplicate."""
    e = expected.select("hash", "source").distinct().withColumn("e", F.lit(1))
    m = moves.groupBy("hash", "source").agg(F.count("*").alias("m"))
    problem = F.when(F.col("m").isNull(), "omitted").when(F.col("e").isNull(), "extra").when(F.col("m") > 1, "duplicate")
    return e.join(m, ["hash", "source"], "full_outer").select("hash", "source", problem.alias("problem")).filter("problem is not null")


def merge_candidates(rows: DataFrame) -> DataFrame:
    """By hash the distinct paths and aliases in order of first appearance; `conflict` where sizes contradict."""

    def ordered(name: str, out: str) -> DataFrame:
        """Copies meet as one row for each distinct value before any array is made."""
        first = rows.select("hash", "pos", F.posexplode(name).alias("i", "v")).groupBy("hash", "v").agg(F.min(F.struct("pos", "i")).alias("at"))
        return first.groupBy("hash").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias(out))

    base = rows.groupBy("hash").agg(F.min("pos").alias("first_pos"), F.min("size").alias("size"), (F.min("size") != F.max("size")).alias("conflict"))
    both = base.join(ordered("paths", "paths"), "hash", "left").join(ordered("original_hashes", "aliases"), "hash", "left")
    none = F.array().cast("array<string>")
    return both.select("hash", "first_pos", F.coalesce("paths", none).alias("paths"), F.coalesce("aliases", none).alias("aliases"), "size", "conflict")


def dangling(packs: DataFrame, entries: DataFrame, present: DataFrame) -> DataFrame:
    """Catalogued packs and entries whose container isn't there: (kind, pack_id, hash)."""
    p = packs.select("pack_id").join(present.select("pack_id"), "pack_id", "left_anti").select(F.lit("record").alias("kind"), "pack_id", F.lit(None).cast("string").alias("hash"))
    e = entries.join(present.select("pack_id"), "pack_id", "left_anti").select(F.lit("entry").alias("kind"), "pack_id", "hash")
    return p.unionByName(e)


def recoveries(lost: DataFrame, loose: DataFrame, members: DataFrame) -> DataFrame:
    """Lost entries whose bytes are still there as a valid loose object of a member."""
    return lost.join(loose.filter("valid").select("hash").distinct(), "hash", "left_semi").join(members.select("hash"), "hash", "left_semi")


def orphan_adoptions(footers: DataFrame, packs: DataFrame, members: DataFrame, readable: DataFrame) -> DataFrame:
    """Footer entries of uncatalogued containers: adopt members not readable elsewhere; `remove_pack` where none is."""
    orphan = footers.join(packs.select("pack_id"), "pack_id", "left_anti")
    good = orphan.join(members.select("hash"), "hash", "left_semi").join(readable.select("hash"), "hash", "left_anti").select("pack_id", "hash", F.lit(1).alias("g"))
    n = orphan.join(good, ["pack_id", "hash"], "left").groupBy("pack_id").agg(F.count("*").alias("entries"), F.count("g").alias("adopted"))
    return n.withColumn("remove_pack", F.col("adopted") == 0)


def sweep_loose(loose: DataFrame, entries: DataFrame, members: DataFrame, complete: bool) -> DataFrame:
    """Loose objects by what to do: remove (packed), orphan (no member; only if the inventory is complete), keep."""
    e = entries.select("hash", F.lit(1).alias("packed")).distinct()
    m = members.select("hash", F.lit(1).alias("ref")).distinct()
    action = F.when(F.col("packed").isNotNull(), "remove").when(F.col("ref").isNull() & F.lit(complete), "orphan").otherwise("keep")
    return loose.join(e, "hash", "left").join(m, "hash", "left").select(*loose.columns, action.alias("action"))


def footer_mismatches(entries: DataFrame, footers: DataFrame) -> DataFrame:
    """Catalogue entries that their container's footer lacks or describes otherwise."""
    fields = ["offset", "stored_len", "raw_len", "flags", "crc32c"]
    f = footers.select("pack_id", "hash", *[F.col(c).alias(f"f_{c}") for c in fields])
    why = F.when(F.col("f_offset").isNull(), "missing")
    for c in fields:
        why = why.when(F.col(c) != F.col(f"f_{c}"), c)
    return entries.join(f, ["pack_id", "hash"], "left").select("pack_id", "hash", why.alias("problem")).filter("problem is not null")


def overlaps(entries: DataFrame) -> DataFrame:
    """Entries that begin before an earlier one of their pack ends; empty ones don't count."""
    w = Window.partitionBy("pack_id").orderBy("offset", F.col("offset") + F.col("stored_len"), "hash").rowsBetween(Window.unboundedPreceding, -1)
    return entries.filter("stored_len > 0").withColumn("reach", F.max(F.col("offset") + F.col("stored_len")).over(w)).filter("offset < reach").select("pack_id", "hash", "offset", "reach")


def classify_objects(paths: DataFrame) -> DataFrame:
    """Kind and key of every path of a store: loose raw, loose zstd, pack or unknown."""
    p = F.col("path")
    h = F.regexp_extract(p, r"^(?:loose/)?([0-9a-f]{2})/([0-9a-f]{64})(\.zst)?$", 2)
    shard = F.regexp_extract(p, r"^(?:loose/)?([0-9a-f]{2})/", 1)
    pack = F.regexp_extract(p, r"^packs/[0-9a-z]{2}/([0-9a-hjkmnp-tv-z]{26})\.(?:mvpack|pack)$", 1)
    loose = (h != "") & (F.left(h, F.lit(2)) == shard)
    encoding = F.when(p.endswith(".zst"), "zstd").otherwise("raw")
    kind = F.when(loose, F.concat(F.lit("loose "), encoding)).when(pack != "", "pack").otherwise("unknown")
    key = F.when(loose, F.concat(F.lit("loose/"), encoding, F.lit("/"), h)).when(pack != "", F.concat(F.lit("pack/"), pack)).otherwise(F.concat(F.lit("unknown/"), p))
    return paths.select("path", kind.alias("kind"), key.alias("ref_key"))


def health_order(candidates: DataFrame) -> DataFrame:
    """Candidates of each hash, healthy first, else as they came: adds attempt from 0."""
    score = F.col("store_failed").cast("int") + 2 * F.col("location_failed").cast("int")
    return candidates.withColumn("health", score).withColumn("attempt", F.row_number().over(Window.partitionBy("hash").orderBy("health", "cand_pos")) - 1)


def headline(failures: DataFrame) -> DataFrame:
    """The worst failure of each hash: corrupt, missing, fenced, unavailable; the first of those as bad."""
    rank = F.when(F.col("kind") == "corrupt", 4).when(F.col("kind") == "missing", 3).when(F.col("kind") == "fenced", 2).otherwise(1)
    return failures.groupBy("hash").agg(F.max_by("kind", F.struct(rank, -F.col("cand_pos"))).alias("kind"), F.count("*").alias("tried"))


def limit_problem(entries: Column, data_bytes: Column) -> Column:
    """Which limit a container would break, in the order entries, footer, container; else null."""
    footer = FOOTER_HEAD + FOOTER_ENTRY * entries
    return F.when(entries > MAX_ENTRIES, "entries").when(footer > MAX_FOOTER, "footer").when(data_bytes + footer + TRAILER > MAX_CONTAINER, "container")


def entry_problem() -> Column:
    """Why an entry is invalid, else null; the first reason in this order counts."""
    o, s, r = F.col("offset"), F.col("stored_len"), F.col("raw_len")
    return (
        F.when(~is_digest(F.col("hash")), "hash").when((s < 0) | (r < 0), "negative").when(o < FIRST_OFFSET, "offset").when(~F.col("flags").isin(0, 1), "flags")
        .when(s > MAX_BLOB, "stored").when(r > (1 << 32), "raw").when((F.col("crc32c") < 0) | (F.col("crc32c") >= (1 << 32)), "crc32c")
    )


def duplicates(entries: DataFrame) -> DataFrame:
    return entries.groupBy("pack_id", "hash").agg(F.count("*").alias("n")).filter("n > 1")


def budget(rows: DataFrame, most: int, by: list[str], order: str = "pos", size: str = "raw_len") -> DataFrame:
    """Rows of each group up to and with the one that crosses the budget."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("before", before).filter(F.col("before") < most)
