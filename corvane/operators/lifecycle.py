"""What a store does as a whole: verify, restore proof, create, pack, repack, unpack, import, move.

Each is composed from the catalogue, page and snapshot operators; the result is the plan or report as rows. Verdicts
are made once for each distinct blob and joined to what refers to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import is_digest, path_problem
from corvane.operators import catalog as C
from corvane.operators import pages as P
from corvane.operators import snapshots as S

#: Names, number and bytes of a snapshot's auxiliary artifacts.
ARTIFACT_NAME, MAX_ARTIFACTS, MAX_ARTIFACT_BYTES = "^[a-z0-9][a-z0-9._-]{0,127}$", 64, 64 << 20


def blob_verdicts(ids: DataFrame, index: DataFrame, footers: DataFrame, payloads: DataFrame | None = None) -> DataFrame:
    """For each distinct hash of ids what is wrong with it, else null: (hash, raw_len, structural, detail).

    missing: no index has it; footer x: its container's footer lacks it or differs in x; content: payloads(hash, got)
    has no bytes for it or bytes of another hash. Without payloads only structure is looked at.
    """
    known = index.select("hash", "pack_id", "raw_len", F.lit(1).alias("known"))
    wrong = C.footer_mismatches(index, footers).select("hash", F.concat(F.lit("footer "), F.col("problem")).alias("footer"))
    out = ids.select("hash").distinct().join(known, "hash", "left").join(wrong, "hash", "left")
    detail = F.when(F.col("known").isNull(), "missing").otherwise(F.col("footer"))
    structural = detail.isNull()
    if payloads is not None:
        out = out.join(payloads.select("hash", "got"), "hash", "left")
        detail = F.coalesce(detail, F.when(~F.col("got").eqNullSafe(F.col("hash")), "content"))
    return out.select("hash", "raw_len", structural.alias("structural"), detail.alias("detail"))


def verify(manifests: DataFrame, refs: DataFrame, index: DataFrame, footers: DataFrame, payloads: DataFrame | None = None) -> DataFrame:
    """All problems of all snapshots, none ends the run: (snapshot_id, hash, detail).

    A blob's verdict is repeated for every snapshot that refers to it; sizes are compared for sound blobs; hashes listed
    twice in a snapshot and manifests(snapshot_id, blobs, bytes) whose totals are wrong are reported too.
    """
    verdict = blob_verdicts(refs, index, footers, payloads)
    each = refs.select("snapshot_id", "hash", "size").distinct().join(verdict, "hash")
    detail = F.coalesce("detail", F.when(F.col("raw_len") != F.col("size"), "size"))
    blobs = each.select("snapshot_id", "hash", detail.alias("detail")).filter("detail is not null")
    twice = refs.groupBy("snapshot_id", "hash").agg(F.count("*").alias("n")).filter("n > 1").select("snapshot_id", "hash", F.lit("repeated").alias("detail"))
    totals = S.totals_problems(manifests, refs).select("snapshot_id", F.lit(None).cast("string").alias("hash"), F.lit("totals").alias("detail"))
    return blobs.unionByName(twice).unionByName(totals)


def verify_counters(refs: DataFrame, index: DataFrame, footers: DataFrame, payloads: DataFrame) -> DataFrame:
    """Distinct blobs whose structure holds and the bytes of those that were read well, each counted once."""
    v = blob_verdicts(refs, index, footers, payloads)
    zero = F.lit(0).cast("long")
    return v.agg(F.count_if("structural").alias("blobs_checked"), F.coalesce(F.sum(F.when(F.col("detail").isNull(), F.col("raw_len"))), zero).alias("bytes_read"))


def list_equality(lists: DataFrame, paths: DataFrame, index: DataFrame) -> DataFrame:
    """Where lists(hash) and restored paths(hash, path) aren't one inventory: (hash, path, problem).

    no path: listed, but nothing restored refers to it; unlisted: the reverse; not indexed: no index has it; else a
    path's own fault or collision: its folded form belongs to another hash too.
    """
    listed, restored = lists.select("hash").distinct(), paths.select("hash").distinct()
    none = F.lit(None).cast("string").alias("path")
    say = lambda df, what: df.select("hash", none, F.lit(what).alias("problem"))
    sets = say(listed.join(restored, "hash", "left_anti"), "no path").unionByName(say(restored.join(listed, "hash", "left_anti"), "unlisted"))
    sets = sets.unionByName(say(listed.join(index.select("hash"), "hash", "left_anti"), "not indexed"))
    key = S.folded_key(F.col("path"))
    folded = paths.select("hash", "path").distinct().withColumn("f", key)
    clash = folded.groupBy("f").agg(F.min("hash").alias("lo"), F.max("hash").alias("hi")).filter("lo < hi").select("f", F.lit("collision").alias("c"))
    own = folded.join(clash, "f", "left").select("hash", "path", F.coalesce(path_problem(F.col("path")), "c").alias("problem")).filter("problem is not null")
    return sets.unionByName(own)


def compact_json(json: Column) -> Column:
    """The text without white space outside strings; order and spelling stay."""
    return F.regexp_replace(json, r'("(?:[^"\\]|\\.)*")|[ \t\r\n]+', "$1")


def restore_proof(pages: DataFrame, hashes: DataFrame, lists: DataFrame, paths: DataFrame, index: DataFrame, stats: DataFrame) -> DataFrame:
    """Whether a restore may be published: for each check the number of problems, zero included.

    pages(page, hash) are the restored ones, hashes those of the snapshot; stats(restored, manifest) are JSON texts.
    """
    both = hashes.select("page", F.col("hash").alias("want")).join(pages.select("page", "hash"), "page", "full_outer")
    wrong = both.filter(~F.col("want").eqNullSafe(F.col("hash"))).agg(F.count("*").alias("problems")).select(F.lit("pages").alias("check"), "problems")
    kept = list_equality(lists, paths, index).agg(F.count("*").alias("problems")).select(F.lit("lists").alias("check"), "problems")
    differ = stats.filter(~compact_json(F.col("restored")).eqNullSafe(compact_json(F.col("manifest")))).agg(F.count("*").alias("problems"))
    return wrong.unionByName(kept).unionByName(differ.select(F.lit("stats").alias("check"), "problems"))


def restore_order(refs: DataFrame, index: DataFrame) -> DataFrame:
    """refs(hash, pos) by the pack that holds them, packs in order of first appearance: (pack_order, pack_id, hash, pos)."""
    at = refs.groupBy("hash").agg(F.min("pos").alias("pos")).join(index.select("hash", "pack_id"), "hash")
    first = at.groupBy("pack_id").agg(F.min("pos").alias("pack_order"))
    return at.join(first, "pack_id").select("pack_order", "pack_id", "hash", "pos")


def create(pages: DataFrame, parent: DataFrame, parent_count: int, refs: DataFrame, seen: DataFrame, index: DataFrame) -> DataFrame:
    """What an incremental snapshot writes, as one row.

    Changed pages and their runs; attachments refs(hash, pos, size, stored_len) in count and bytes; of these the hashes
    that go on a new list, as the parent's lists lack them; bytes_added: stored bytes of hashes that no index has;
    relist: whether the parent's lists have what is gone, so that the whole list is written anew.
    """
    dirty = P.dirty(pages, parent, parent_count)
    first = refs.groupBy("hash").agg(F.min("size").alias("size"), F.min("stored_len").alias("stored_len"))
    zero = F.lit(0).cast("long")
    totals = first.agg(F.count("*").alias("blobs"), F.coalesce(F.sum("size"), zero).alias("bytes"))
    added = first.join(index.select("hash"), "hash", "left_anti").agg(F.coalesce(F.sum("stored_len"), zero).alias("bytes_added"))
    listed = S.capture(refs.select("hash", "pos", "size"), seen).agg(F.count("*").alias("new_listed"))
    gone = S.shrank(seen, refs).agg((F.count("*") > 0).alias("relist"))
    runs = P.runs_of(dirty).agg(F.coalesce(F.sum("count"), zero).alias("dirty_pages"), F.count("*").alias("dirty_runs"))
    return runs.crossJoin(totals).crossJoin(added).crossJoin(listed).crossJoin(gone)  # each side is one row


def pack(loose: DataFrame, members: DataFrame, entries: DataFrame) -> DataFrame:
    """What packing does with each object: (hash, action).

    prune: a mapping of no member; pack: a loose member that no pack has; remove: a loose copy of what a pack has and
    a member refers to; orphan: a loose object of no member; a packed object of no member loses its mapping first.
    """
    stale = C.unreferenced(entries, members)
    live = C.live_entries(entries, members)
    swept = C.sweep_loose(loose.select("hash").distinct(), live, members, complete=True)
    action = F.when(F.col("action") == "keep", "pack").otherwise(F.col("action"))
    return stale.select("hash", F.lit("prune").alias("action")).unionByName(swept.select("hash", action.alias("action")))


def repack(packs: DataFrame, entries: DataFrame, members: DataFrame, footers: DataFrame, now: Column, min_dead: int = C.MIN_DEAD) -> DataFrame:
    """Packs to rewrite in their order and what moves out of each: (rank, pack_id, partial, moved, moved_bytes, problems).

    problems counts live entries that the footer contradicts; such a pack isn't touched.
    """
    live = C.live_entries(entries, members)
    chosen = C.repack_candidates(C.usage(packs, live), now, min_dead=min_dead)
    bad = C.footer_mismatches(live, footers).groupBy("pack_id").agg(F.count("*").alias("problems"))
    zero = F.lit(0).cast("long")
    out = chosen.join(bad, "pack_id", "left").select("partial", "created_at", "pack_id", F.col("live").alias("moved"), F.col("live_stored").alias("moved_bytes"), F.coalesce("problems", zero).alias("problems"))
    return C.repack_order(out).drop("created_at")


def unpack(packs: DataFrame, entries: DataFrame, members: DataFrame, footers: DataFrame) -> DataFrame:
    """Each pack with the live entries that become loose objects again: (pack_id, blobs_restored, bytes_restored, problem).

    problem: the container is missing though entries point to it, or its footer contradicts one of them; entries of
    packs without a record are reported as no record. Work goes by pack_id.
    """
    live = C.live_entries(entries, members)
    n = live.groupBy("pack_id").agg(F.count("*").alias("n"), F.sum("raw_len").alias("raw"))
    bad = C.footer_mismatches(live, footers).groupBy("pack_id").agg(F.lit(1).alias("bad"))
    there = footers.select("pack_id", F.lit(1).alias("there")).distinct()
    record = packs.select("pack_id", F.lit(1).alias("record"))
    out = record.join(n, "pack_id", "full_outer").join(there, "pack_id", "left").join(bad, "pack_id", "left")
    problem = F.when(F.col("record").isNull(), "no record").when(F.col("n").isNotNull() & F.col("there").isNull(), "missing").when(F.col("bad").isNotNull(), "footer")
    zero = F.lit(0).cast("long")
    return out.select("pack_id", F.coalesce("n", zero).alias("blobs_restored"), F.coalesce("raw", zero).alias("bytes_restored"), problem.alias("problem"))


def fallback_reason(encoding_ok: Column, entries: Column, data_bytes: Column) -> Column:
    """Why a whole container isn't imported directly, else null."""
    limit = C.limit_problem(entries, data_bytes)
    by_limit = F.when(limit == "container", "pack_container_limit").when(limit == "footer", "pack_footer_limit").when(limit == "entries", "pack_entry_count_limit")
    return F.when(~encoding_ok, "pack_encoding").otherwise(by_limit)


def import_outcomes(packs: DataFrame, footers: DataFrame, selections: DataFrame, blob_bytes: int = C.MAX_BLOB) -> DataFrame:
    """What becomes of each selection(pack_id, hash, offset, stored_len, raw_len, flags): (pack_id, hash, outcome).

    packs(pack_id, encoding_ok, entry_count, data_bytes). A pack's fallback holds for all of its selections; then
    duplicate (the hash is selected more than once in all), absent, mismatch, blob_limit; adopt is what remains.
    """
    fields = ["offset", "stored_len", "raw_len", "flags"]
    f = footers.select("pack_id", "hash", *[F.col(c).alias(f"f_{c}") for c in fields], F.lit(1).alias("in_footer"))
    reason = packs.select("pack_id", fallback_reason(F.col("encoding_ok"), F.col("entry_count"), F.col("data_bytes")).alias("reason"))
    n = selections.groupBy("hash").agg(F.count("*").alias("n"))
    differs = F.lit(False)
    for c in fields:
        differs = differs | (F.col(c) != F.col(f"f_{c}"))
    outcome = (
        F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("n") > 1, "duplicate").when(F.col("in_footer").isNull(), "absent").when(differs, "mismatch")
        .when((F.col("f_raw_len") > blob_bytes) | (F.col("f_stored_len") > blob_bytes), "blob_limit").otherwise("adopt")
    )
    return selections.join(reason, "pack_id", "left").join(n, "hash").join(f, ["pack_id", "hash"], "left").select("pack_id", "hash", outcome.alias("outcome"))


def import_proof(footers: DataFrame, selected: DataFrame, payloads: DataFrame) -> DataFrame:
    """Why a container can't be proven within limits: (pack_id, hash, problem).

    duplicate ids and overlapping spans of the whole footer, which the engine's sorted shuffles find without holding it,
    and selected payloads whose bytes aren't those of their hash.
    """
    twice = C.duplicates(footers).select("pack_id", "hash", F.lit("duplicate").alias("problem"))
    over = C.overlaps(footers).select("pack_id", "hash", F.lit("overlap").alias("problem"))
    read = selected.select("pack_id", "hash").join(payloads.select("hash", "got"), "hash", "left").filter(~F.col("got").eqNullSafe(F.col("hash")))
    return twice.unionByName(over).unionByName(read.select("pack_id", "hash", F.lit("payload").alias("problem")))


def move(wanted: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Objects to copy between stores: (hash, outcome). Authority isn't changed.

    source(hash, size, got) and target(hash) are what the stores hold; wanted(hash, size). present: the target has it;
    missing: the source hasn't; corrupt: size or content isn't what is wanted; copied is what remains.
    """
    s = source.select("hash", F.col("size").alias("s_size"), "got", F.lit(1).alias("held"))
    t = target.select("hash", F.lit(1).alias("there")).distinct()
    bad = (F.col("s_size") != F.col("size")) | ~F.col("got").eqNullSafe(F.col("hash"))
    outcome = F.when(F.col("there").isNotNull(), "present").when(F.col("held").isNull(), "missing").when(bad, "corrupt").otherwise("copied")
    return wanted.join(s, "hash", "left").join(t, "hash", "left").select("hash", outcome.alias("outcome"))


def loose_write(blobs: DataFrame, existing: DataFrame) -> DataFrame:
    """Objects that a write adds, with their shard; what exists already isn't written: (shard, path, hash, size).

    Write the result partitioned by shard.
    """
    new = blobs.filter(is_digest(F.col("hash"))).groupBy("hash").agg(F.min("size").alias("size")).join(existing.select("hash"), "hash", "left_anti")
    shard = F.left("hash", F.lit(2))
    return new.select(shard.alias("shard"), F.concat(shard, F.lit("/"), F.col("hash")).alias("path"), "hash", "size")


def locate(ids: DataFrame, index: DataFrame) -> DataFrame:
    """Reads by id as reads of packs: (pack_id, blobs, first_offset, end), ids that no index has under a null pack."""
    at = ids.select("hash").distinct().join(index.select("hash", "pack_id", "offset", "stored_len"), "hash", "left")
    return at.groupBy("pack_id").agg(F.count("*").alias("blobs"), F.min("offset").alias("first_offset"), F.max(F.col("offset") + F.col("stored_len")).alias("end"))


def manifest_problems(manifests: DataFrame, known: list[str], newest: int) -> DataFrame:
    """Manifests(name, json) that can't be loaded: (name, problem), by id shape, unknown field, newer reader, other id."""
    j = F.col("json")
    at = lambda field: F.get_json_object(j, f"$.{field}")
    keys = F.json_object_keys(j)
    problem = (
        F.when(~F.col("name").rlike(S.SNAPSHOT_ID), "id shape").when(keys.isNull(), "no object")
        .when(F.size(F.array_except(keys, F.array(*[F.lit(k) for k in known]))) > 0, "unknown field")
        .when(at("min_reader").cast("int") > newest, "newer reader").when(~at("snapshot_id").eqNullSafe(F.col("name")), "other id")
    )
    return manifests.select("name", problem.alias("problem")).filter("problem is not null")


def artifact_problems(artifacts: DataFrame) -> DataFrame:
    """artifacts(snapshot_id, name, size) that break a limit: (snapshot_id, name, problem); name is null for a snapshot's own."""
    name = F.col("name")
    own = artifacts.select("snapshot_id", "name", F.when(~name.rlike(ARTIFACT_NAME) | name.isNull(), "name").alias("problem")).filter("problem is not null")
    twice = artifacts.groupBy("snapshot_id", "name").agg(F.count("*").alias("n")).filter("n > 1").select("snapshot_id", "name", F.lit("repeated").alias("problem"))
    total = artifacts.groupBy("snapshot_id").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    problem = F.when(F.col("n") > MAX_ARTIFACTS, "count").when(F.col("b") > MAX_ARTIFACT_BYTES, "bytes")
    whole = total.select("snapshot_id", F.lit(None).cast("string").alias("name"), problem.alias("problem")).filter("problem is not null")
    return own.unionByName(twice).unionByName(whole)


def list_positions(refs: DataFrame) -> DataFrame:
    """Each list(snapshot_id, pos, hash) as it is stored: hashes once, in order of first appearance (of a tie, by hash)."""
    first = refs.groupBy("snapshot_id", "hash").agg(F.min("pos").alias("first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("snapshot_id").orderBy("first", "hash")) - 1).select("snapshot_id", "hash", "place")


def blob_table(base: DataFrame, delta: DataFrame) -> DataFrame:
    """The blobs that either interval map names, once."""
    return base.select("blob").union(delta.select("blob")).distinct()
