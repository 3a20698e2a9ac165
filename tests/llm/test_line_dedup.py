import random

import duckdb
import pytest

from larkspur.llm.line_dedup import OP10_SQL, dedup_lines, op10_line_dedup


def near(a, b, least):
    a, b = a.split(), b.split()
    if a == b:
        return True
    if max(len(a), len(b)) < least or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def norm(line):
    return " ".join(line.lower().split(" ")).strip()


def brute(docs, least):
    seen, out = [], []
    for _, text in docs:
        if text is None:
            out.append(None)
            continue
        keep = []
        for line in text.split("\n"):
            k = " ".join(line.lower().split())
            if not k or not any(near(k, s, least) for s in seen):
                keep.append(line)
            if k:
                seen.append(k)
        out.append("\n".join(keep))
    return out


def cases(seed, n=60):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefgh") + str(rng.randint(0, 6)) for _ in range(rng.randint(1, 20))] for _ in range(25)]

    def line():
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            i = rng.randrange(len(w) + 1)
            kind = rng.randrange(3)
            if kind == 0:
                w.insert(i, "new" + str(rng.randint(0, 3)))
            elif w[i:]:
                w[i : i + 1] = ["x" + str(rng.randint(0, 3))] if kind == 1 else []
        return (" " * rng.randint(0, 1)) + rng.choice([" ", "  "]).join(w).upper() if rng.random() < 0.2 else " ".join(w)

    docs = ["\n".join(line() for _ in range(rng.randint(0, 6))) for _ in range(n)]
    return list(enumerate([*docs, None, "", "\n\n", docs[3], "tail \n\n end"]))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = cases(seed)
    frame = spark.createDataFrame([(t, i, "en", 5) for i, t in docs], "text string, doc_id long, __kept string, n_chars int").repartition(3)
    got = {r.doc_id: r for r in dedup_lines(frame, length_col="n_chars").collect()}
    want = brute(docs, 8)
    assert [got[i].text for i, _ in docs] == want
    assert all(r.n_chars == (5 if r.text is None else len(r.text)) and r["__kept"] == "en" for r in got.values())


def test_equals_sql(spark, tmp_path):
    docs = [(i, t) for i, t in cases(7)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(OP10_SQL)
    got = op10_line_dedup(spark, str(tmp_path))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_ties_nulls_and_nothing(spark):
    rows = [(None, "a b"), (1, "a b\nc"), (1, "a b\nc"), (1, "c\nd"), (2, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(dedup_lines(frame).collect(), key=lambda r: (r.doc_id or 0, r.text or ""))
    assert [r.text for r in got if r.doc_id is None] == ["a b"]
    assert sorted(r.text for r in got if r.doc_id == 1) in (["", "", "c\nd"], ["c", "c", "d"])
    assert dedup_lines(frame.limit(0)).count() == 0
