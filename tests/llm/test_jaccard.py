"""The Jaccard join and components against brute force."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logsluice.llm import jaccard
from logsluice.llm.common import LONG, PIECE, components, shingle_sets


def brute(rows, n=5):
    sets = {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return sorted((d, len(s), root(d)) for d, s in sets.items())


def corpus(seed, families=12, passage=True):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    common = [word() for _ in range(40)]
    rows = [(1000 + i, t) for i, t in enumerate([None, "", "  \n", "One two", "one TWO", "a b c d", "x " * 900, "X " * 700, "é É b c d e"])]
    for f in range(families):
        base = [word() for _ in range(rng.choice([6, 20, 60, 200]))] + (common if passage and f % 3 == 0 else [])
        for c in range(rng.choice([1, 2, 8, 25])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((f * 50 + c, " ".join(copy)))
    rng.shuffle(rows)
    return rows


def test_components_match_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame([(i, t, "clash", 3) for i, t in rows], "doc_id long, text string, token string, n int").repartition(5)
        assert sorted(map(tuple, jaccard.jaccard_components(docs).collect())) == brute(rows)


def test_pivots_keep_components_exact(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PART_BYTES", 900)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for d in range(60):  # copies of one text, of which many pairs are just under the threshold
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2])):
            copy[rng.randrange(60)] = f"x{rng.randrange(900)}"
        rows.append((d, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, jaccard.jaccard_components(docs).collect())) == brute(rows)


def test_long_lists_are_split_without_loss(spark):
    rows = spark.createDataFrame([(1, d, 40, 39, d % 7) for d in range(60)], "list long, doc_id long, n int, rest int, part long")
    known = rows.select("doc_id", "part").withColumnRenamed("doc_id", "node").withColumnRenamed("part", "component")
    none = rows.select("doc_id", F.lit(1).cast("long").alias("pivot")).limit(0)
    assert jaccard.open_pairs(rows.drop("part"), known, rows.select("doc_id", F.lit(1).cast("long").alias("pivot"))).isEmpty()
    for most in (7, 1000):
        found = {(r.a, r.b) for r in jaccard.open_pairs(rows.drop("part"), known, none, most).collect()}
        assert found == {(a, b) for a in range(60) for b in range(a) if a % 7 != b % 7} or found == {(b, a) for a in range(60) for b in range(a) if a % 7 != b % 7}


def test_repeated_null_and_empty(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, jaccard.jaccard_components(docs).collect())) == sorted(
        map(str, spark.createDataFrame([(5, 2, 2), (5, 2, 2), (None, 2, None), (2, 2, 2), (9, 0, 9)], "doc_id long, n_shingles long, component_id long").collect())
    )
    assert jaccard.jaccard_components(docs.limit(0)).collect() == []
    assert sorted(r.doc_id or 0 for r in jaccard.keep_one(docs).collect()) == [0, 2, 9]


def test_an_id_with_several_texts_is_one_document(spark):
    near = lambda k: " ".join([f"w{i}" for i in range(40)] + [f"x{k}"])
    rows = [(1, "some other words that are not like it"), (1, near(1)), (2, near(2)), (3, "some other words that are not like it"), (4, "alone"), (None, near(3)), (5, None), (5, "")]
    got = sorted(map(str, jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    want = [(1, 4, 1), (1, 37, 1), (2, 37, 1), (3, 4, 1), (4, 1, 4), (None, 37, None), (5, 0, 5), (5, 0, 5)]
    assert got == sorted(map(str, spark.createDataFrame(want, "doc_id long, n_shingles long, component_id long").collect()))


def test_sketches_never_understate(spark):
    rng = np.random.default_rng(3)
    for wide in (40, 1 << 40):  # 40: all hashes have equal first bits, or many do
        for _ in range(300):
            pool = np.unique(rng.integers(0, wide, 60).astype(np.uint64) << np.uint64(20))
            x, y = (np.sort(rng.choice(pool, rng.integers(1, len(pool)), replace=False)) for _ in range(2))
            cut = lambda t: (t[: -(-len(t) // jaccard.SKETCH)] >> np.uint64(32)).astype("<u4")
            assert jaccard.most_shared(cut(x), len(x), cut(y), len(y)) >= len(np.intersect1d(x, y))


def test_sets_of_many_texts_at_once_are_those_of_each():
    rng = random.Random(6)
    words = [b"a", b"A", b"ab", b"ba", b"aB", "é".encode(), "É".encode(), b"x" * LONG, b"X" * LONG + b"y", b"x" * LONG + b"z", b"q" * (2 * PIECE), b"Q" * (2 * PIECE)]
    some = lambda n, most: b"".join(rng.choice(words[:most]) + rng.choice([b" ", b"\t", b"\n\v", b"\f \r", "\u00a0".encode()]) for _ in range(n))
    texts = [b"", b" \n", b"a", b"A ", b"one two three four", *(some(rng.randrange(9), 10) for _ in range(300)), some(30, 12), b"w " * PIECE, some(PIECE, 10), *(some(rng.randrange(60), 10) for _ in range(300))]
    for most in (1, 5_000, 1 << 30):
        found = [x for tokens, sizes in shingle_sets(texts, 5, most) for x in np.split(tokens, np.cumsum(sizes)[:-1])]
        assert len(found) == len(texts)
        for text, got in zip(texts, found, strict=True):
            w = text.lower().split()
            want = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
            assert len(got) == len(want) and (np.diff(got.astype(object)) > 0).all()
        flat = [set(x.tolist()) for x in found[:305]]
        plain = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in texts[:305]]
        for _ in range(3_000):
            i, j = rng.randrange(305), rng.randrange(305)
            assert len(flat[i] & flat[j]) == len(plain[i] & plain[j])
    assert list(shingle_sets([])) == []


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=60))
def test_components_of_any_graph(spark, edges):
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in up:
        for a, b in edges:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    assert found == up
