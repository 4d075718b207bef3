"""Vector near-duplicates against brute force."""

import math
import random

import numpy as np

from corvane.llm import embed_lsh


def brute(rows, threshold=0.93):
    ok = {i: (np.array(v, float), lab) for i, v, lab, *_ in rows if v and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = {i: set() for i, *_ in rows}
    for a, (x, p) in ok.items():
        for b, (y, q) in ok.items():
            if a < b and p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[a].add(b)
                links[b].add(a)

    def low(i):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        return min(seen)

    return {i: (len(links[i]), low(i), low(i) == i) for i in links}


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string")
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_lsh.near_duplicate_vectors(spark, df, **more).collect()}


def test_clusters(spark, monkeypatch):
    monkeypatch.setattr(embed_lsh, "BLOCK", 16)  # hot buckets go in several blocks
    rng, rows = np.random.default_rng(1), []
    for c in range(12):
        base = rng.normal(size=64)
        for _ in range(rng.integers(1, 40)):
            rows.append((len(rows), (base + rng.normal(size=64) * rng.uniform(0, 0.22)).astype(np.float32).tolist(), c % 3, "x"))
        rows += [(len(rows) + k, rows[-1][1], c % 3, "x") for k in range(3)]
    random.Random(2).shuffle(rows)
    got, want = run(spark, rows), brute(rows)
    found, links = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert found >= 0.999 * links and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i][1] == want[i][1] for i in want) >= len(want) - 2


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0, "x"), (2, v, 0, "x"), (3, v, None, "x"), (4, None, 0, "x"), (5, [], 0, "x"), (6, [0.0, 0.0, 0.0], 0, "x"), (7, [1.0, float("nan"), 1.0], 0, "x"), (8, [1.0, None, 1.0], 0, "x"), (9, [2.0, 4.0, 6.0], 0, "x"), (10, v, 1, "x"), (11, [float("inf"), 1.0, 1.0], 0, "x"), (12, v + v, 0, "x"), (13, [-1.0, -2.0, -3.0], 0, "x"), (14, [1e30, 2e30, 3e30], 0, "x")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:1] + rows[:1]) == {1: (0, 1, True)}
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embed_lsh.near_duplicate_vectors(spark, df).count() == 0


def test_rotations_keep_lengths():
    x = np.random.default_rng(0).normal(size=(5, 64))
    y = embed_lsh.hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(embed_lsh.hadamard(y), x)
