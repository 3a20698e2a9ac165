"""The manifest against plain Python trees; nulls, ties, repeats, a hot group, empty tables and clashing columns."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from larkspur.llm.merkle_manifest import folded, leaf_digest, manifest, proof_digest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, at string, g long, path string, `a b` int"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row) -> str:
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def levels(row: list[str]) -> list[list[str]]:
    out = [row]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree: list[list[str]], k: int) -> list[str]:
    out = []
    for row in tree[:-1]:
        start = k // 16 * 16
        out += [x for i, x in enumerate(row[start : start + 16], start) if i != k]
        k //= 16
    return out


def expected(rows) -> list[tuple]:
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([d for _, d in sorted((((r[0] is not None, r[0] or 0), leaf(r)) for r in groups[s]))]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for i, s in enumerate(names):
        ordered = sorted(((r[0] is not None, r[0] or 0), leaf(r), r[0]) for r in groups[s])
        for k, (_, own, doc) in enumerate(ordered):
            out.append((doc, s, own, trees[s][-1][0], top[-1][0], digest(*siblings(trees[s], k), *siblings(top, i))))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "p", 7) for r in rows], SCHEMA)


def found(spark, rows, parts=None):
    docs = table(spark, rows)
    out = manifest(docs.repartition(parts) if parts else docs)
    out = out.select("doc_id", "source", "leaf", "subroot", "root", proof_digest().alias("proof"), folded(F.col("leaf")).alias("again"))
    got = out.collect()
    assert all(r["again"] == r["root"] for r in got)
    return sorted((tuple(r)[:6] for r in got), key=repr)


CASES = {
    "nulls and ties": [(1, "a", "en", 3, "x"), (1, "a", "en", 3, "y"), (1, "a", "en", 3, "y"), (None, "a", None, None, None), (None, None, None, None, ""), (2, None, "de", 1, "Ä"), (3, "", "", 0, ""), (4, "é", "fr", 2, "z"), (5, "z", "fr", 2, "z" * 100_000), (6, "😀", "fr", 2, "q")],
    "one leaf": [(7, "a", "en", 1, "x")],
    "one group of 17": [(k, "a", "en", 1, str(k)) for k in range(17)],
    "a hot group beside many small ones": [(k, "hot" if k % 3 else f"s{k}", "en", k, f"text {k}") for k in range(900)],
    "all in one id": [(5, "s", "en", 1, f"{k % 40}") for k in range(300)],
}


@pytest.mark.parametrize("name", CASES)
def test_equals_plain_trees(spark, name):
    assert found(spark, CASES[name], 3) == expected(CASES[name])


def test_many_partitions_leave_open_runs(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "70")
    try:
        rows = [(k, "hot" if k % 2 else f"s{k % 5}", "en", k, f"text {k}") for k in range(1500)]
        assert found(spark, rows) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty_table(spark):
    out = manifest(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["doc_id", "source", "leaf", "subroot", "root", "path"] and out.count() == 0


def test_tampering_shows(spark):
    rows = CASES["one group of 17"]
    other = leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.lit("forged"))
    out = manifest(table(spark, rows), others={"forged": other})
    assert out.where(folded(F.col("forged")) == F.col("root")).count() == 0
