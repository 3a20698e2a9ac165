import random

import pytest

import larkspur.llm.suffix_dedup as sd


def brute(docs, length):
    seen, out = set(), []
    for d, text in docs:
        data = (text or "").encode()
        gone = [False] * len(data)
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = [True] * length
            seen.add(w)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(data), sum(gone), runs, bytes(b for b, g in zip(data, gone) if not g)))
    return out


def cases(seed, n=120):
    rng = random.Random(seed)
    say = lambda k: "".join(rng.choice("abcdeé \n") for _ in range(k))
    common = [say(rng.choice([60, 80, 99, 100, 101, 130, 400])) for _ in range(8)]
    base = [say(rng.randint(0, 900)) for _ in range(15)]
    docs = []
    for _ in range(n):
        t = rng.choice(base) if rng.random() < 0.5 else say(rng.randint(0, 400))
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, len(t))
            t = t[:i] + rng.choice([rng.choice(common), "x", ""]) + t[i + rng.randint(0, 3) :]
        docs.append(t)
    return [*docs, None, "", "a" * 700, "ab" * 300, "a" * 99, "q" * 100, "q" * 100, common[0] * 9]


@pytest.mark.parametrize(("seed", "length", "often"), [(1, 100, 256), (2, 100, 2), (3, 64, 16), (4, 77, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, length, often):
    monkeypatch.setattr(sd, "FREQUENT", often)
    docs = list(enumerate(cases(seed)))
    frame = spark.createDataFrame([(t, d * 3, 9) for d, t in docs], "text string, doc_id long, base int").repartition(7)
    got = sorted((tuple(r) for r in sd.remove_repeats(frame, length).collect()))
    want = [(d * 3, *rest) for d, *rest in brute(docs, length)]
    assert got == want and sum(r[2] for r in want) > 10_000


def test_blocks_inside_a_text(spark, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK", 150)
    docs = list(enumerate(cases(5, 40)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r) for r in sd.remove_repeats(frame).collect()) == brute(docs, 100)


def test_ties_nulls_and_nothing(spark):
    text = "".join(random.Random(1).choices("abcdefgh", k=250))
    rows = [(None, text), (1, text + "!"), (1, "?" + text), (2, text), (2, text), (3, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed, bytes(r.kept)) for r in sd.remove_repeats(frame).collect())
    assert got[0] == (0, 0, text.encode())
    assert [g[1] for g in got[1:]] == [250, 250, 250, 250, 0]
    assert sd.remove_repeats(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sd.remove_repeats(frame, 20)
