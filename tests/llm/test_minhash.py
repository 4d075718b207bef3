"""Near-duplicate documents against brute force, and the odd cases."""

import random

import pytest

from corvane.llm import minhash
from corvane.llm.shared import Scratch, connected_components


def brute(rows, num=85, den=100):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    low[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark, df, **more).collect()}


@pytest.fixture(scope="module")
def copies():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    shared, rows, i = [word() for _ in range(120)], [], 0
    for _ in range(12):
        base = [word() for _ in range(r.randint(60, 300))]
        for _ in range(r.randint(1, 7)):
            t = base[:]
            for _ in range(r.randint(0, 4)):
                t[r.randrange(len(t))] = word()
            rows.append((i, " ".join(t)))
            i += 1
    for _ in range(30):  # a common passage in texts that are otherwise their own
        rows.append((i, " ".join([word() for _ in range(r.randint(5, 40))] + shared)))
        i += 1
    r.shuffle(rows)
    return rows


def test_against_brute_force(spark, copies):
    assert run(spark, copies) == brute(copies)


def test_odd_rows(spark):
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (5, "A  B\nC"), (6, "a b"), (7, long), (8, long.upper()), (9, "é é é é é"), (10, "É é é é é"), (11, "x" * 200_000), (12, "x" * 200_000)]
    assert run(spark, rows) == brute(rows)


def test_empty_repeated_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 3, 1), (1, "a b c d e f", 4, 2), (None, "a b c d e f", 4, 2), (2, "a b c d e f", 4, 2)], "doc_id long, text string, component_id int, key int")
    assert sorted(map(tuple, minhash.near_duplicates(spark, df).collect())) == [(1, 2, 1, True), (2, 2, 1, False)]
    assert minhash.near_duplicates(spark, df.filter("false")).count() == 0


def test_components_against_union_find(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(500, 540)] + [(900, 900)]
    low = {i: i for e in edges for i in e if e[0] != e[1]}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            low[y] = x
    got = connected_components(Scratch(spark, "t"), spark.createDataFrame(edges, "src long, dst long"))
    assert sorted(map(tuple, got.collect())) == sorted((i, root(i)) for i in low)


def test_last_step_hands_on_every_pair_that_shares_a_table(spark, monkeypatch):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(4):
        base = [word() for _ in range(200)]
        for _ in range(50):
            t = base[:]
            for _ in range(r.randint(1, 2)):
                t[r.randrange(len(t))] = word()
            rows.append((len(rows), " ".join(t)))
    asked = []

    def confirm(scratch, docs, pairs, num, den):  # no link is found, so that the last step is left with all pairs
        asked.append([(x.a, x.b) for x in pairs.collect()])
        return scratch.keep(spark.createDataFrame([], "src long, dst long"), "links")

    monkeypatch.setattr(minhash, "_confirm", confirm)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    minhash.near_duplicates(spark, df, num=80)
    stars, rest = asked
    blocks = {x.doc_id: x.blocks for x in minhash.features(df, 4, 14).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t in rows}
    want = set()
    for a in sets:
        for b in range(a + 1, a - a % 50 + 50):
            same = [x == y for x, y in zip(blocks[a], blocks[b], strict=True)]
            if any(same[:14]) and any(same[14:]) and sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                want.add((a, b))
    assert len(want - set(stars)) > 1500
    assert sorted(want - set(stars) - set(rest)) == []
    assert len(rest) == len(set(rest))


def test_of_equal_ids_the_largest_set_counts(spark):
    """Only the row that counts takes part: what links is what is returned."""
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "a b c"), (1, long), (2, long + " end"), (3, "a b c"), (4, None), (4, "x"), (4, "x")]
    assert run(spark, rows) == {1: (56, 1, True), 2: (57, 1, False), 3: (1, 3, True), 4: (1, 4, True)}


def test_recall_by_similarity(spark):
    """Pairs planted at known similarities from the threshold up are all found."""
    r = random.Random(8)
    rows, i = [], 0
    for _ in range(150):
        base = [f"v{r.randrange(10**9)}" for _ in range(400)]
        other = base[:]
        for k in r.sample(range(0, 400, 5), r.randint(1, 6)):
            other[k] = f"u{r.randrange(10**9)}"
        rows += [(i, " ".join(base)), (i + 1, " ".join(other))]
        i += 2
    assert run(spark, rows) == brute(rows)


def test_a_document_has_one_row_a_table(spark, monkeypatch):
    """In a large group of texts that share much, a document's rows are bounded by the tables, not by pairs of them."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    shared = [word() for _ in range(200)]
    rows = [(i, " ".join(shared + [word() for _ in range(20 + i % 5)])) for i in range(120)]
    seen, keep = {}, Scratch.keep

    def count(self, df, tag):
        out = keep(self, df, tag)
        seen.setdefault(tag, out.count() if tag in ("buckets", "open") else 0)
        return out

    monkeypatch.setattr(Scratch, "keep", count)
    assert run(spark, rows, num=80) == brute(rows, num=80)
    assert 0 < seen["buckets"] <= 38 * len(rows)


@pytest.mark.parametrize("bits", [8, 1 << 24])
def test_keep_firsts_is_the_semi_join(spark, monkeypatch, bits):
    """Maps in which most ids collide give the same rows as ones in which none do; texts stay where they are in the latter."""
    monkeypatch.setattr(minhash, "MAP_BITS", bits)
    docs = spark.createDataFrame([(None if i % 50 == 0 else i // 2, f"text {i}", i) for i in range(400)], "doc_id int, text string, part int")
    found = spark.createDataFrame([(i, i % 3 > 0) for i in range(200)], "doc_id long, kept boolean")
    want = docs.join(found.filter("kept").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    got = minhash.keep_firsts(docs, found)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    none = minhash.keep_firsts(docs, found.withColumn("kept", found.doc_id >= 0))
    assert none.count() == docs.filter("doc_id is not null").count()


def test_a_large_component_isnt_dealt_against_itself(spark, monkeypatch):
    """Every two members of different components meet once; a large component with a few others costs a row or two a member."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    buckets = {1: [0] * 160 + [1, 2], 2: [0] * 3 + [1] * 4, 3: [0] * 30 + list(range(1, 20)), 4: [0] * 20}
    rows = [(k, 5, 1000 * k + i, lab, True) for k, labs in buckets.items() for i, lab in enumerate(labs)]
    dealt = minhash._deal(spark.createDataFrame(rows, "key long, band long, id long, lab long, home boolean")).collect()
    assert {x.key for x in dealt} == {1, 2, 3}
    assert sum(x.key == 1 for x in dealt) <= 160 + 2 * (1 + 20)
    groups, met = {}, []
    for x in dealt:
        groups.setdefault((x.key, x.p, x.q), []).append(x)
    for (_, p, q), g in groups.items():
        met += [tuple(sorted((x.id, y.id))) for i, x in enumerate(g) for y in g[i + 1 :] if x.lab != y.lab and {x.part, y.part} == {p, q}]
    want = [(a[2], b[2]) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[0] == b[0] and a[3] != b[3]]
    assert sorted(met) == sorted(want)


def test_against_brute_force_in_small_blocks(spark, copies, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    assert run(spark, copies, num=80) == brute(copies, num=80)
