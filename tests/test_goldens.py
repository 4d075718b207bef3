"""Fixed cases of chunking, ranking, fingerprints, containers, pages and statistics."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import crc32c, scalars, text, vectors
from corvane.operators import pages as P
from corvane.operators import retrieval as R
from corvane.operators import stats
from corvane.sources import containers, texts

CHUNKS = [
    ("", 4, 0, []), (" \t\n ", 4, 0, []), ("hello world", 0, 0, ["0:hello world"]), ("abcd", 8, 0, ["0:abcd"]), ("abcdefghij", 5, 0, ["0:abcde", "1:fghij"]),
    ("abcdefghij", 4, 1, ["0:abcd", "1:defg", "2:ghij"]), ("abcd    efgh", 4, 0, ["0:abcd", "2:efgh"]), ("abcd​﻿‍⁠efgh", 4, 0, ["0:abcd", "2:efgh"]),
    ("​hi﻿", 4, 0, ["0:​hi﻿"]), ("⠀ㅤ", 4, 0, ["0:⠀ㅤ"]), ("abcdef", 3, 9, ["0:abc", "1:bcd", "2:cde", "3:def"]),
    ("😀😁😂🤣", 2, 0, ["0:😀😁", "1:😂🤣"]), (None, 3, 0, []),
]


@pytest.mark.parametrize("content,size,overlap,want", CHUNKS)
def test_chunks(spark, content, size, overlap, want):
    row = spark.createDataFrame([(content,)], "t string").select(text.split_chunks(F.col("t"), size, overlap).alias("c")).first()
    assert [f"{c.idx}:{c.text}" for c in row.c] == want


def hits(spark, rows):
    return spark.createDataFrame([(g, d, c, s, p) for p, (g, d, c, s) in enumerate(rows)], "gen_pos int, doc int, chunk_index int, score float, pos int")


def test_rollup_keeps_best_chunk_and_first_on_ties(spark):
    out = R.rollup_by_document(hits(spark, [(0, 1, 0, 0.2), (0, 2, 0, 0.9), (0, 1, 3, 0.7), (0, 2, 1, 0.9)])).orderBy("rank").collect()
    assert [(r.doc, r.chunk_index) for r in out] == [(2, 0), (1, 3)]


def test_merges(spark):
    raw = R.rollup_by_document(hits(spark, [(0, 1, 0, 0.5), (0, 2, 0, 0.4), (1, 1, 0, 0.99), (1, 3, 0, 0.8)]))
    out = {r.doc: round(r.score, 2) for r in R.merge(raw).collect()}
    assert out == {1: 0.5, 2: 0.4, 3: 0.8}
    assert [r.doc for r in R.merge(raw, limit=2).collect()] == [3, 1]
    norm = R.merge(R.rollup_by_document(hits(spark, [(0, 3, 0, 0.2), (0, 4, 0, 0.1), (1, 1, 0, 0.9), (1, 2, 0, 0.85)])), "normalized", 2).collect()
    assert [(r.doc, r.score) for r in norm] == [(3, 1.0), (1, 1.0)]
    rrf = R.merge(R.rollup_by_document(hits(spark, [(0, 10, 0, 0.99), (0, 99, 0, 0.98), (1, 99, 0, 0.5), (1, 20, 0, 0.49)])), "rrf", 4).first()
    assert rrf.doc == 99
    assert R.merge(raw.filter("false")).count() == 0


def test_fingerprint(spark):
    row = spark.createDataFrame([("m", 3, {"b": "2", "a": "1"})], "m string, d int, p map<string,string>").select(scalars.fingerprint(F.col("m"), F.col("d"), F.col("p"))).first()
    assert row[0] == "51df6188da434255"


def test_crc32c():
    assert crc32c.crc32c(b"alpha") == 2027499393
    assert crc32c.crc32c(b"") == 0

    def plain(data):
        r = 0xFFFFFFFF
        for b in data:
            r ^= b
            for _ in range(8):
                r = r >> 1 ^ (0x82F63B78 if r & 1 else 0)
        return r ^ 0xFFFFFFFF

    data = bytes(random.Random(3).randbytes(9001))
    assert crc32c.crc32c(data) == plain(data)


def test_containers_round_trip_and_damage(spark, tmp_path):
    blobs = [b"", b"alpha", b"the same line\n" * 800, random.Random(1).randbytes(5000)]
    containers.write_containers(spark, spark.createDataFrame([(b,) for b in blobs], "content binary").coalesce(1), f"file://{tmp_path}/c", 4000)
    got = containers.read_blobs(spark, f"file://{tmp_path}/c").collect()
    assert sorted(bytes(r.content) for r in got) == sorted(blobs) and all(r.problem is None for r in got)
    foot = {r.raw_len: r for r in containers.read_footers(spark, f"file://{tmp_path}/c").collect()}
    assert foot[5].crc32c == 2027499393 and foot[5].flags == 0 and foot[11200].flags == 1 and foot[5000].stored_len == 5000
    sealed = containers.seal([b"alpha" * 500])
    for at, problem in ((-1, "magic"), (-50, "checksum"), (0, "magic")):
        bad = bytearray(sealed)
        bad[at] ^= 1
        assert containers.footer_entries(bytes(bad))[1] == problem
    assert containers.footer_entries(sealed[:20])[1] == "truncated"
    assert containers.blob_of(b"x", 1, 0, crc32c.crc32c(b"x"), "00")[1] == "digest"
    assert containers.blob_of(b"x", 1, 0, 1, "00")[1] == "crc32c"


def test_interval_map_against_pages(spark):
    for seed in range(3):
        r = random.Random(seed)
        base, at = [], 0
        while at < 60:
            n = r.randint(1, 9)
            base.append((at, n, f"b{r.randint(0, 3)}", r.randint(0, 50)))
            at += n
        delta = [(s, 3, "d", s) for s in r.sample(range(0, 60, 4), 5)]
        count = r.randint(20, at + 4)
        model = {}
        for runs in (base, delta):
            for s, n, b, o in runs:
                model.update({s + i: (b, o + i) for i in range(n)})
        schema = "start_page long, page_count long, blob string, blob_offset long"
        got = P.apply_runs(spark.createDataFrame(base, schema), spark.createDataFrame(delta, schema), count).collect()
        pages = {x.start_page + i: (x.blob, x.blob_offset + i) for x in got for i in range(x.page_count)}
        assert pages == {p: v for p, v in model.items() if p < count}


def test_u_test_counts_arrangements():
    x, y = np.array([1.0, 2, 3, 4, 5]), np.array([6.0, 7, 8, 9, 10])
    assert stats.u_test(x, y) == pytest.approx(2 / 252)
    assert stats.u_test(np.array([1.0, 4, 5, 8]), np.array([2.0, 3, 6, 7])) == pytest.approx(1.0)
    assert stats.u_test(np.ones(6), np.ones(6)) == 1.0


def test_compare_verdicts(spark):
    rows = lambda name, unit, values: [(name, unit, float(v)) for v in values]
    old = rows("a", "sec/op", [1, 1.1, 1.2, 1.3, 1.4]) + rows("b", "sec/op", [1, 1.1]) + rows("c", "B/op", [5000] * 2) + rows("gone", "B/op", [1])
    new = rows("a", "sec/op", [5, 5.1, 5.2, 5.3, 5.4]) + rows("b", "sec/op", [9, 9.1]) + rows("c", "B/op", [9000] * 2) + rows("fresh", "B/op", [1])
    schema = "name string, unit string, value double"
    got = {r.name: r.verdict for r in stats.compare(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()}
    assert got == {"a": "regression", "b": "skipped", "c": "regression", "gone": "missing", "fresh": "new"}


def test_text_sources(spark, tmp_path):
    (tmp_path / "b.txt").write_text("pkg: x/y\nBenchmarkSave-8  100  2000 ns/op  16 B/op\nnoise\nBenchmarkLoad 5 3 sec/op\n")
    got = {(r.name, r.unit, round(r.value, 9)) for r in texts.bench_lines(spark, f"file://{tmp_path}/b.txt").collect()}
    assert got == {("x/y.Save-8", "sec/op", 2e-6), ("x/y.Save-8", "B/op", 16.0), ("x/y.Load", "sec/op", 3.0)}
    porcelain = "worktree /a b\r\nHEAD 123\r\nbranch refs/heads/main\r\nlocked why not\r\n\r\nbare\n\nworktree /c\ndetached\nprunable\nodd field\n"
    w = texts.worktree_blocks(spark.createDataFrame([(porcelain,)], "value string")).orderBy("pos").collect()
    assert [(x.path, x.branch, x.locked, x.locked_reason, x.detached, x.prunable) for x in w] == [("/a b", "main", True, "why not", False, False), ("/c", None, False, None, True, True)]
    c = texts.config_options(spark.createDataFrame([("User me\n  HostName  a b \nalone\n\n",)], "value string")).collect()
    assert [(x.name, x.value) for x in c] == [("user", "me"), ("hostname", "a b")]
    digest = "A" * 64
    t = spark.createDataFrame([(f"{digest}  other\n{digest} *./tool.zip\n",), ("none",)], "t string")
    assert [r[0] for r in t.select(texts.checksum_for(F.col("t"), "tool.zip")).collect()] == ["a" * 64, None]
    (tmp_path / "d.7.json").write_text('{"pid": 7, "address": "x", "started_at": "2024-01-01T00:00:00Z"}')
    (tmp_path / "d.8.json").write_text('{"pid": 9, "address": "x", "started_at": "2024-01-01T00:00:00Z"}')
    assert [r.pid for r in texts.runtime_records(spark, f"file://{tmp_path}/*.json", "d").collect()] == [7]


def test_sanitising(spark):
    t = "\x1b[1;31mred\x1b[0m\tx\r\ny\x07​ \x1b]8;;http://a\x1b\\link\x1b]8;;\x1b\\"
    row = spark.createDataFrame([(t,)], "t string").select(text.sanitize_line(F.col("t")), text.sanitize_block(F.col("t"))).first()
    assert tuple(row) == ("red x y link", "red\tx\ny link")


def test_vector_batches_hold_nulls_and_odd_lengths(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0]), (5, [3.0, 4.0])], "i int, v array<float>").coalesce(1)
    got = {r.i: r.s for r in df.select("i", vectors.cosine_to([1.0, 0.0], F.col("v")).alias("s")).collect()}
    assert got == {1: 1.0, 2: None, 3: None, 4: 0.0, 5: pytest.approx(0.6)}


def test_runs_and_gaps_do_not_depend_on_stretches(spark):
    pages = [0, 1, 2, 3, 4, 5, 7, 8, 11, 12, 16, 20, 21, 22, 23, 24]
    df = spark.createDataFrame([(p,) for p in pages], "page long")
    assert sorted(tuple(r) for r in P.runs_of(df, 4).collect()) == [(0, 6), (7, 2), (11, 2), (16, 1), (20, 5)]
    runs = spark.createDataFrame([(0, 3), (3, 6), (9, 1), (12, 2), (13, 1), (30, 2)], "start_page long, page_count long")
    assert sorted(tuple(r) for r in P.coverage_gaps(runs, 40, 4).collect()) == [(10, 12), (14, 13), (14, 30), (32, 40)]
    assert [tuple(r) for r in P.coverage_gaps(runs.limit(0), 5, 4).collect()] == [(0, 5)]


def test_batches_do_not_depend_on_stretches(spark):
    refs = spark.createDataFrame([(d, c) for d in (1, 2, 5, 9, 10, 40) for c in range(d % 4 + 1)], "doc long, chunk_index int")
    want = sorted(tuple(r) for r in R.encode_batches(refs, 3).collect())
    assert want == sorted(tuple(r) for r in R.encode_batches(refs, 3, 4).collect()) and {r[0] for r in want} == {0, 1, 2, 3, 4}


def test_chains_tell_cycles_and_missing_parents(spark):
    s = spark.createDataFrame([("a", None, 0), ("b", "a", 1), ("c", "b", 2), ("x", "gone", 1), ("y", "x", 2), ("p", "q", 1), ("q", "p", 1)], "snapshot_id string, parent_id string, depth int")
    got = P.chains(s, spark.createDataFrame([("c",), ("y",), ("q",), ("none",)], "head string"), 4).collect()
    by = {h: [(r.snapshot_id, r.problem) for r in sorted(got, key=lambda r: r.step) if r.head == h] for h in "cyq"}
    assert len(got) == 10
    assert by["c"] == [("c", None), ("b", None), ("a", None)] and by["y"] == [("y", None), ("x", "missing parent")]
    assert by["q"] == [("q", None), ("p", None), ("q", None), ("p", None), ("q", "too long")]


def test_run_check_moves_only_pages_that_have_a_hash(spark):
    runs = spark.createDataFrame([(0, 5, "a", 0), (5, 1 << 31, "b", 7), (1 << 40, 2, "c", 0), (3, 0, "d", 0)], "start_page long, page_count long, blob string, blob_offset long")
    hashes = spark.createDataFrame([(0, "x"), (4, "x"), (6, "x"), (1 << 31, "x"), ((1 << 40) + 1, "x"), (1 << 41, "x")], "page long, hash string")
    stored = spark.createDataFrame([("a", 0, "x"), ("a", 4, "y"), ("b", 8, "x"), ("c", 1, "x")], "blob string, at long, hash string")
    got = P.run_mismatches(runs, stored, hashes).collect()  # a run of more pages than an array holds
    assert sorted(tuple(r) for r in got) == [(0, "a", 4), (5, "b", 1 << 31)]


def test_delta_runs_are_not_expanded_to_pages(spark):
    schema = "start_page long, page_count long, blob string, blob_offset long"
    far = 1 << 40
    base = [(0, far, "a", 5), (far, 10, "b", 0), (far + 20, 10, "c", 3), (far + 30, 0, "e", 0)]
    delta = [(far // 2, 3, "d", 0), (far - 1, 3, "d", 3), (far + 25, 100, "d", 6)]
    got = P.apply_runs(spark.createDataFrame(base, schema), spark.createDataFrame(delta, schema), far + 40).collect()
    half = far // 2
    want = [(0, half, "a", 5), (half, 3, "d", 0), (half + 3, half - 4, "a", half + 8), (far - 1, 3, "d", 3), (far + 2, 8, "b", 2), (far + 20, 5, "c", 3), (far + 25, 15, "d", 6)]
    assert sorted(tuple(r) for r in got) == want


def test_delta_runs_do_not_depend_on_stretches(spark):
    schema = "start_page long, page_count long, blob string, blob_offset long"
    r = random.Random(7)
    for _ in range(6):
        maps = [[(r.randint(0, 60), r.randint(0, 9), f"{m}{k}", 100 * k) for k in range(n)] for m, n in (("b", 12), ("d", 6))]  # runs that overlap, too
        maps = [runs + runs[:2] for runs in maps]
        count, model = r.randint(30, 70), {}
        for runs in maps:
            own = {}
            for s, n, b, o in sorted(runs, key=lambda x: (x[0], -x[1], x[2])):
                for i in range(n):
                    own.setdefault(s + i, (b, s, o + i))
            model |= own
        want, was = [], None
        for p in sorted(p for p in model if p < count):
            b, s, o = model[p]
            if was == (p - 1, b, s):
                want[-1][1] += 1
            else:
                want.append([p, 1, b, o])
            was = (p, b, s)
        frames = [spark.createDataFrame(runs, schema) for runs in maps]
        for step in (4, 1000):
            assert sorted(list(x) for x in P.apply_runs(*frames, count, step).collect()) == want


def test_steps_of_chains_broadcast_nothing(spark):
    s = spark.createDataFrame([("a", None, 0), ("b", "a", 1)], "snapshot_id string, parent_id string, depth int")
    plan = P.chains(s, spark.createDataFrame([("b",)], "head string"))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert len(joins) == 2 and all("strategy=merge" in line for line in joins)


def test_reflow_tries_columns_without_a_row_for_each(spark):
    long = ["abc"] * 3000
    rows = [("a", 0, ["x", "yyyy", "zz"]), ("a", 1, ["xxx", None]), ("b", 0, ["w" * 50, "v"]), ("c", 0, long), ("d", 0, [None, None]), ("e", 0, []), (None, 0, ["x"])]
    df = spark.createDataFrame(rows, "layout string, row int, cells array<string>")
    got = stats.reflow(df, 13)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "Join" not in plan  # cells become rows, trials don't
    assert sorted(tuple(r) for r in got.collect()) == [("a", 3, 13), ("b", 1, 50), ("c", 3, 13), ("d", 1, None)]
    assert {r.layout: (r.columns, r.width) for r in stats.reflow(df.filter("layout <> 'c'"), 0).collect()} == {"a": (3, 13), "b": (2, 53), "d": (2, None)}
    assert {r.layout: (r.columns, r.width) for r in stats.reflow(df.filter("layout < 'c'"), 8, 0).collect()} == {"a": (2, 7), "b": (1, 50)}
