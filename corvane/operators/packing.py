"""Greedy plans over metadata: rotation of packs, page blobs. Each group is a fold in order.

A fold depends on all that came before it in its group, so one task works through a group, but never holds it: rows
come sorted, an Arrow batch at a time, and a few numbers are carried on. Groups are stores or snapshots, whose
metadata (a few numbers a blob or a run) is small against their data.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Pages from which a range gets blobs of its own, and the most in a blob.
OWN_PAGES, BLOB_PAGES = 256, 1024


def _longs(rows: list[tuple[int, ...]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(names), names=names)


def rotate(blobs: DataFrame, target: int, max_entries: int) -> DataFrame:
    """blobs(grp, pos, stored_len) with the pack each goes to: one closes once it has target bytes or before it exceeds its entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, now = False, None
        pack = written = held = 0
        for batch in batches:
            out = []
            for grp, pos, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or grp != now:
                    begun, now, pack, written, held = True, grp, 0, 0, 0
                elif written >= target or held >= max_entries:
                    pack, written, held = pack + 1, 0, 0
                out.append((grp, pos, size, pack))
                written, held = written + size, held + 1
            yield _longs(out, ["grp", "pos", "stored_len", "pack"])

    rows = blobs.selectExpr("cast(grp as long) grp", "cast(pos as long) pos", "cast(stored_len as long) stored_len")
    return rows.repartition("grp").sortWithinPartitions("grp", "pos").mapInArrow(run, "grp long, pos long, stored_len long, pack long")


def plan_blobs(ranges: DataFrame) -> DataFrame:
    """ranges(grp, start, count) of dirty pages in blobs: large ranges are cut, small ones share a blob until it is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, now, plan, held = False, None, 0, 0
        for batch in batches:
            out = []
            for grp, start, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or grp != now:
                    begun, now, plan, held = True, grp, 0, 0
                if count >= OWN_PAGES:
                    plan, held = plan + (held > 0), 0
                    for at in range(start, start + count, BLOB_PAGES):
                        out.append((grp, plan, at, min(BLOB_PAGES, start + count - at)))
                        plan += 1
                    continue
                if held and held + count > BLOB_PAGES:
                    plan, held = plan + 1, 0
                out.append((grp, plan, start, count))
                held += count
            yield _longs(out, ["grp", "plan", "start", "count"])

    rows = ranges.selectExpr("cast(grp as long) grp", "cast(start as long) start", "cast(count as long) count")
    return rows.repartition("grp").sortWithinPartitions("grp", "start").mapInArrow(run, "grp long, plan long, start long, count long")
