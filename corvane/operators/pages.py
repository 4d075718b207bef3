"""Pages and snapshots of them: hashes, changes, runs, interval maps, chains.

Relations: pages(page, hash), runs(start_page, page_count, blob, blob_offset in pages). Runs are intervals and
stay intervals: they meet by their ends or by stretches of page numbers and are never expanded to pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pages of one window in which runs are found before their ends are joined.
STRETCH = 65_536


def page_hash(data: Column) -> Column:
    """The first 16 bytes of SHA-256 as hex."""
    return F.left(F.sha2(data, 256), F.lit(32))


def dirty(pages: DataFrame, parent: DataFrame, parent_count: int) -> DataFrame:
    """Pages that the parent lacks, that lie beyond its count or whose hash differs."""
    p = parent.select("page", F.col("hash").alias("was"))
    return pages.join(p, "page", "left").filter(F.col("was").isNull() | (F.col("page") >= parent_count) | (F.col("was") != F.col("hash"))).select("page", "hash")


def runs_of(pages: DataFrame, step: int = STRETCH) -> DataFrame:
    """Consecutive pages as (start, count): islands within stretches of `step` pages, then islands of those that touch.

    Only islands that reach an end of their stretch, two at most for each, are ordered as a whole.
    """
    stretch = F.floor(F.col("page") / step)
    inner = pages.select("page", stretch.alias("s")).withColumn("g", F.col("page") - F.row_number().over(Window.partitionBy("s").orderBy("page")))
    part = inner.groupBy("s", "g").agg(F.min("page").alias("a"), (F.max("page") + 1).alias("b"))
    at_edge = (F.col("a") % step == 0) | (F.col("b") % step == 0)
    w = Window.orderBy("a")
    edge = part.filter(at_edge).withColumn("new", (F.coalesce(F.lag("b").over(w), F.lit(-1)) != F.col("a")).cast("int"))
    edge = edge.withColumn("k", F.sum("new").over(w)).groupBy("k").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return part.filter(~at_edge).select("a", "b").union(edge.select("a", "b")).select(F.col("a").alias("start"), (F.col("b") - F.col("a")).alias("count"))


def run_offsets(plan: DataFrame, page_size: int) -> DataFrame:
    """plan(plan, start, count) with each run's byte offset in its blob."""
    w = Window.partitionBy("plan").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return plan.withColumn("blob_offset", F.coalesce(F.sum("count").over(w), F.lit(0)) * page_size)


def apply_hashes(base: DataFrame, delta: DataFrame, page_count: int) -> DataFrame:
    """Delta over base, cut to the new count."""
    d = delta.select("page", F.col("hash").alias("d"))
    return base.select("page", "hash").join(d, "page", "full_outer").select("page", F.coalesce("d", "hash").alias("hash")).filter(F.col("page") < page_count)


def growth_gaps(base_count: int, delta: DataFrame, page_count: int) -> DataFrame:
    """Pages between the old and new count that the delta doesn't have; such a delta is refused."""
    grown = delta.sparkSession.range(base_count, max(base_count, page_count)).select(F.col("id").alias("page"))
    return grown.join(delta.select("page"), "page", "left_anti")


def _disjoint(runs: DataFrame, page_count: int, step: int) -> DataFrame:
    """(start, end, blob, blob_offset) of runs cut to page_count; a page of several runs goes to the one that starts first, then the longest."""
    start, stop = F.col("start_page"), F.least(F.col("start_page") + F.col("page_count"), F.lit(page_count))
    r = runs.filter(F.col("page_count") > 0).select("start_page", stop.alias("end"), "blob", "blob_offset", F.floor(start / step).alias("s")).filter(F.col("end") > start)
    reach = r.groupBy("s").agg(F.max("end").alias("reach"))
    before = reach.select("s", F.max("reach").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    w = Window.partitionBy("s").orderBy("start_page", F.desc("end"), "blob", "blob_offset").rowsBetween(Window.unboundedPreceding, -1)
    own = r.join(before, "s").withColumn("start", F.greatest("start_page", F.max("end").over(w), "before")).filter("start < end")
    return own.select("start", "end", "blob", (F.col("blob_offset") + F.col("start") - start).alias("blob_offset"))


def apply_runs(base: DataFrame, delta: DataFrame, page_count: int, step: int = STRETCH) -> DataFrame:
    """Delta runs over base runs, cut to the new count; base runs are split where the delta covers them.

    Offsets count pages. Fragments of different runs stay apart even where they touch; within a map, see _disjoint for
    runs that overlap. A fragment begins where a base run begins or a delta run ends, so runs are swept as rows for their
    ends, ordered within stretches of `step` pages; one row for each stretch is ordered as a whole.
    """
    b, d = _disjoint(base, page_count, step), _disjoint(delta, page_count, step)
    none = F.lit(None).cast("long")
    at_base = b.select(F.col("start").alias("pos"), F.struct("start", "end", "blob", "blob_offset").alias("run"), none.alias("covered"), none.alias("opens"))
    ends = F.array(F.struct(F.col("start").alias("pos"), F.col("end").alias("covered"), F.col("start").alias("opens")), F.struct(F.col("end").alias("pos"), none.alias("covered"), none.alias("opens")))
    at_delta = d.select(F.explode(ends).alias("e")).select("e.*").withColumn("run", F.lit(None).cast(at_base.schema["run"].dataType))
    events = at_base.unionByName(at_delta).withColumn("s", F.floor(F.col("pos") / step))
    whole = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    stretch = events.groupBy("s").agg(F.max("run").alias("run"), F.max("covered").alias("covered"), F.min("opens").alias("opens"))
    outer = stretch.select("s", F.max("run").over(whole).alias("run0"), F.max("covered").over(whole).alias("covered0"), F.min("opens").over(rest).alias("opens0"))
    upto = Window.partitionBy("s").orderBy("pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    above = Window.partitionBy("s").orderBy(F.desc("pos")).rangeBetween(Window.unboundedPreceding, -1)
    swept = events.join(outer, "s").select(
        "pos", F.coalesce(F.max("run").over(upto), "run0").alias("r"), F.greatest(F.max("covered").over(upto), "covered0").alias("covered"), F.coalesce(F.min("opens").over(above), "opens0").alias("next"),
        F.col("run").isNotNull().alias("is_base"), F.col("opens").isNotNull().alias("opening"),
    )
    begins = F.col("is_base") | (~F.col("opening") & (F.col("r.start") < F.col("pos")) & (F.col("r.end") > F.col("pos")))
    left = swept.filter(begins & (F.coalesce("covered", "pos") <= F.col("pos")))
    kept = left.select(F.col("pos").alias("start_page"), (F.least("r.end", "next") - F.col("pos")).alias("page_count"), "r.blob", (F.col("r.blob_offset") + F.col("pos") - F.col("r.start")).alias("blob_offset"))
    return kept.union(d.select(F.col("start").alias("start_page"), (F.col("end") - F.col("start")).alias("page_count"), "blob", "blob_offset"))


def coverage_gaps(runs: DataFrame, page_count: int, step: int = 1 << 16) -> DataFrame:
    """Where sorted runs don't tile [0, page_count): (expected, found).

    Runs are ordered within stretches of `step` pages; only one row for each stretch is ordered as a whole.
    """
    end = F.col("start_page") + F.col("page_count")
    r = runs.select("start_page", end.alias("end"), F.floor(F.col("start_page") / step).alias("s"))
    ends = r.groupBy("s").agg(F.max_by("end", "start_page").alias("end"))
    before = ends.select("s", F.lag("end").over(Window.orderBy("s")).alias("before"))
    w = Window.partitionBy("s").orderBy("start_page")
    inner = r.withColumn("lag", F.lag("end").over(w)).join(before, "s").select(F.coalesce("lag", "before", F.lit(0)).alias("expected"), F.col("start_page").alias("found"))
    last = runs.agg(F.coalesce(F.max(end), F.lit(0)).alias("expected")).select("expected", F.lit(page_count).cast("long").alias("found"))
    return inner.unionByName(last).filter("expected <> found")


def _holding(points: DataFrame, runs: DataFrame, step: int) -> DataFrame:
    """Rows of points with start_page, blob and `at` of each run that holds their page: an equi-join on stretches of `step` pages, then the bounds."""
    r = runs.filter("page_count > 0").withColumn("__s", F.explode(F.sequence(F.floor(F.col("start_page") / step), F.floor((F.col("start_page") + F.col("page_count") - 1) / step))))
    p = points.withColumn("__s", F.floor(F.col("page") / step))
    inside = (F.col("page") >= F.col("start_page")) & (F.col("page") < F.col("start_page") + F.col("page_count"))
    return p.join(r, "__s").filter(inside).select(*points.columns, "start_page", "blob", (F.col("blob_offset") + F.col("page") - F.col("start_page")).alias("at"))


def lookup(points: DataFrame, runs: DataFrame, step: int = 1024) -> DataFrame:
    """The run that holds each page: rows of points(page, ...) with blob and at."""
    return _holding(points, runs, step).drop("start_page")


def run_mismatches(runs: DataFrame, stored: DataFrame, hashes: DataFrame, step: int = 1024) -> DataFrame:
    """The first page of each run whose stored bytes don't hash to what the map says: stored(blob, at, hash).

    Each page of hashes finds its runs, so rows moved grow with runs and hashes, not with the pages that runs span.
    """
    at = _holding(hashes.select("page", "hash"), runs, step)
    s = stored.select("blob", "at", F.col("hash").alias("got"))
    bad = at.join(s, ["blob", "at"], "left").filter(~F.col("got").eqNullSafe(F.col("hash")))
    return bad.groupBy("start_page", "blob").agg(F.min("page").alias("page"))


def materialize(history: DataFrame, page_count: int) -> DataFrame:
    """Latest hash of each page over a valid chain: history(page, hash, ordinal)."""
    return history.groupBy("page").agg(F.max_by("hash", "ordinal").alias("hash")).filter(F.col("page") < page_count)


def keyframe_due(chains: DataFrame, most_depth: int = 30) -> DataFrame:
    """chains(snapshot, pos from 0 = keyframe, stored): whether the next snapshot of each starts a new chain."""
    totals = chains.groupBy("snapshot").agg(F.max("pos").alias("depth"), F.sum(F.when(F.col("pos") == 0, F.col("stored"))).alias("key_bytes"), F.coalesce(F.sum(F.when(F.col("pos") > 0, F.col("stored"))), F.lit(0)).alias("delta_bytes"))
    due = F.col("key_bytes").isNull() | (F.col("depth") + 1 >= most_depth) | (F.col("delta_bytes") > F.col("key_bytes"))
    return totals.select("snapshot", F.when(due, 0).otherwise(F.col("depth") + 1).alias("next_depth"), F.coalesce("key_bytes", F.lit(0)).alias("key_bytes"), "delta_bytes", due.alias("keyframe"))


def chains(snapshots: DataFrame, heads: DataFrame, most: int = 30) -> DataFrame:
    """The snapshots from each head(head) to its keyframe (depth 0), head first, one join a step for all heads together.

    snapshots(snapshot_id, parent_id, depth) with one row for each id. problem tells on the last row of a chain why it
    doesn't end at a keyframe: 'missing parent', or 'too long' after `most` steps, where a cycle ends too; else null.
    A head that isn't there has no row. No join of a step broadcasts a side, which would go through the driver again at
    every step. Spark's limit on the rows of a recursion is lifted where the session sets none.
    """
    spark = snapshots.sparkSession
    if spark.conf.get("spark.sql.cteRecursionRowLimit", None) is None:
        spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    found = spark.sql(
        """WITH RECURSIVE c(head, snapshot_id, parent_id, depth, step) AS (
             SELECT /*+ MERGE(h, s) */ h.head, s.snapshot_id, s.parent_id, s.depth, 0 FROM {heads} h JOIN {snapshots} s ON s.snapshot_id = h.head
             UNION ALL
             SELECT /*+ MERGE(s, c) */ c.head, s.snapshot_id, s.parent_id, s.depth, c.step + 1 FROM {snapshots} s JOIN c ON s.snapshot_id = c.parent_id
             WHERE c.depth > 0 AND c.step < :most)
           SELECT * FROM c""",
        args={"most": most},
        snapshots=snapshots.select("snapshot_id", "parent_id", "depth"),
        heads=heads.select("head").distinct(),
    )
    last = F.col("step") == F.max("step").over(Window.partitionBy("head"))  # most + 1 rows for each head
    return found.withColumn("problem", F.when(last & (F.col("depth") > 0), F.when(F.col("step") == most, "too long").otherwise("missing parent")))
