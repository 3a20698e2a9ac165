"""Hard negatives against brute force; brackets hold; ties, repeats, nulls, ragged, huge and empty vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm.common import Scratch
from larkspur.llm.hard_negatives import hard_negatives, pivot_table, scaled_rows

SCHEMA = "vec_id long, embedding array<double>, label int, score string, a string, k string"


def plain(rows, every=3, positives=5, negatives=5):
    """All rows of the result, by definition."""
    use = []
    for vec_id, vec, label, *_ in rows:
        if vec_id is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        v = [math.floor(256 * x) for x in vec]
        if sum(x * x for x in v) < 1 << 62:
            use.append((vec_id, v, label))
    out = []
    for a in use:
        if a[0] % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a[1], r[1], strict=False)), r[0], r[2]) for r in use]
        for ps, p, _ in sorted(s for s in scored if s[2] == a[2] and s[1] != a[0])[:positives]:
            near = sorted(s for s in scored if s[2] != a[2] and 80 * -ps <= 100 * -s[0] <= 100 * -ps)
            out += [(a[0], p, k, n, -ps, -ns) for k, (ns, n, _) in enumerate(near[:negatives], 1)]
    return sorted(out)


def found(spark, rows, every=3, **how):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    return sorted(map(tuple, hard_negatives(df.repartition(3), F.col("vec_id") % every == 0, **how).collect()))


def clustered(n, dims, labels, seed, noise=0.6):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(labels, dims))
    return [(k, (centres[k % 4 % labels] + noise * rnd.normal(size=dims)).tolist(), int(rnd.integers(labels))) for k in range(n)]


@pytest.mark.parametrize("how", [{}, {"pivots": 1, "sample": 1}, {"block": 7, "size": 5}, {"pivots": 40, "size": 3}])
def test_equals_brute_force(spark, how):
    rows = clustered(300, 8, 3, 5)
    want = plain(rows)
    assert len(want) > 300 and found(spark, rows, **how) == want


def test_ties_and_copies(spark):
    rows = [(k, [float(k % 3), 1.0], k % 4) for k in range(200)] + [(3, [1.0, 1.0], 2), (3, [1.0, 1.0], 2), (3, [2.0, 1.0], 1)]
    want = plain(rows, every=9)
    assert want and found(spark, rows, every=9, size=11) == want


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0], 1), (3, [1.0, 2.5], 1), (6, None, 1), (9, [1.0, None], 1), (12, [math.nan, 1.0], 1), (15, [math.inf, 0.0], 1), (18, [1.0, 2.0], None), (None, [1.0, 2.0], 1),
        (21, [], 2), (24, [0.0], 2), (27, [1.0, 2.0, 3.0], 2), (1, [0.9, 2.1], 2), (2, [-1.0, -2.0], 2), (4, [1.0, 1.9], 3), (33, [1e300, 0.0], 1), (36, [1e7, 2.0], 1),
    ]
    want = plain(rows)
    assert want and found(spark, rows) == want


def test_scores_beyond_doubles(spark):
    rnd = random.Random(3)
    rows = [(k, [rnd.uniform(0, 2e6) for _ in range(4)], k % 2) for k in range(60)]
    want = plain(rows)
    assert max(w[5] for w in want) > 1 << 53 and found(spark, rows) == want


def test_empty_and_without_anchors(spark):
    assert found(spark, []) == [] and found(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert hard_negatives(spark.createDataFrame([], SCHEMA), F.lit(True)).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_the_table_brackets_every_score(spark):
    rows = clustered(200, 6, 3, 8)
    df = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)
    places, basis = pivot_table(scaled_rows(df, "vec_id", "embedding", F.col("label"), 256), Scratch())
    got = places.collect()
    x = np.array([np.frombuffer(r.v, np.int64) for r in got])
    d = np.array([np.frombuffer(r.dist, float) for r in got])
    a = x[17]
    da = np.sqrt(np.maximum((a @ a) + basis["top"] - 2 * basis["pivots"] @ a, 0))
    true, least, most = x @ a, np.abs(da - d).max(1), (da + d).min(1)
    whole = (a @ a) + basis["top"]
    assert (true <= (whole - least**2) / 2 + 1).all() and (true >= (whole - most**2) / 2 - 1).all()
    assert ((whole - least**2) / 2 < true.max()).any()  # rules something out
