import random

import numpy as np
import pytest

import larkspur.llm.jaccard_join as jj
from larkspur.llm.components import components


def shingle_set(text, k):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(docs, k, percent):
    sets = [(d, shingle_set(t, k)) for d, t in docs]
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((d, len(s), find(d)) for d, s in sets)


def cases(seed, n=160):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.choice([2, 3, 5, 12, 40, 90]))] for _ in range(12)]
    phrase = [f"p{i}" for i in range(12)]

    def text():
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"E{rng.randint(0, 3)}"
        if rng.random() < 0.4:
            w += phrase
        return rng.choice([" ", "\n", " \t"]).join(w)

    docs = list(enumerate(text() for _ in range(n)))
    docs += [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (905, "a b c"), (906, "A b  c")]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("seed", "tile", "k", "percent"), [(1, 64, 4, 85), (2, 3, 4, 85), (3, 2, 5, 80)])
def test_equals_brute_force(spark, monkeypatch, seed, tile, k, percent):
    docs = cases(seed, 160 if tile > 3 else 120)
    assert any(c[0] != c[2] for c in brute(docs, k, percent))
    monkeypatch.setattr(jj, "TILE", tile)  # the tasks get it with the closure
    monkeypatch.setattr(jj, "BLOCK", 2048 if tile > 3 else 5)
    frame = spark.createDataFrame([(t, d, 3) for d, t in docs], "text string, doc_id long, n int").repartition(3)
    got = jj.jaccard_components(frame, words=k, percent=percent)
    assert sorted(map(tuple, got.collect())) == brute(docs, k, percent)


def test_nulls_repeats_and_nothing(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "q r s t u"), (7, "q r s t u"), (9, "a b c d e f"), (9, "a b c d e f")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jj.jaccard_components(frame).collect()), key=repr)
    assert got == sorted([(None, 3, 5), (5, 3, 5), (5, 2, 5), (7, 2, 5), (9, 3, 5), (9, 3, 5)], key=repr)
    assert jj.jaccard_components(frame.limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in jj.drop_near_copies(frame).collect()) == [0, 5, 5]


def test_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        assert jj.overlap_bound(len(a), jj.bitmap(a).tobytes(), len(b), jj.bitmap(b).tobytes()) >= len(np.intersect1d(a, b))


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(30)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
