import random
import re
from hashlib import sha256

import numpy as np

from larkspur.llm.decontaminate import contamination, cut_spans, decontaminate, words
from larkspur.llm.repetition import longest_repeats, repetition_rules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_contamination(text, items, window):
    doc = WORD.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        w = WORD.findall(lower(t))
        wins = {tuple(w[i : i + window]) for i in range(len(w) - window + 1)} if len(w) >= window else {tuple(w)} if w else set()
        for win in wins:
            for i in range(len(doc) - len(win) + 1):
                if tuple(doc[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found.add("null" if item is None else str(item))
    return len(doc), len(hit), len(found), sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def cases(seed=3, n=150):
    rng = random.Random(seed)
    vocab = ["a", "b", "C", "É", "d9"]
    say = lambda k: " ".join(rng.choice(vocab) + rng.choice(["", ",", "!", "\n"]) for _ in range(k))
    items = [(i, say(rng.randint(0, 14))) for i in range(25)] + [(None, "x y z"), (3, "other item three"), (77, None), (78, "")]
    docs = [say(rng.randint(0, 60)) for _ in range(n)] + [None, "", "x Y; z", "x y", "q " * 3000 + "x y z", items[0][1]]
    return docs, items


def test_contamination_equals_brute_force(spark):
    docs, items = cases()
    d = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(docs)], "doc_id long, text string, item_id string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    for window, block in ((4, 100_000), (4, 30), (10, 100_000)):
        got = {r.doc_id: tuple(r)[1:] for r in contamination(d, b, window=window, block_words=block).collect()}
        assert got == {i: brute_contamination(t, items, window) for i, t in enumerate(docs)}
    assert not any(r.contaminated for r in contamination(d, b.limit(0)).collect())
    assert contamination(d.limit(0), b).count() == 0


def test_many_blocks_and_clashing_columns(spark):
    items = [(i, " ".join(f"w{i * 7 + k}" for k in range(12))) for i in range(50)]
    texts = [" ".join(["plain", *(items[i][1].split() if i < 50 else []), *(items[(i + 3) % 50][1].split() if i % 2 else []), *(f"own{i}x{k}" for k in range(40))]) for i in range(120)]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(i, "a", i, t, ["b"]) for i, t in enumerate(texts)], "doc_id long, hit_spans string, hit_items long, text string, items array<string>")
    got = {r.doc_id: tuple(r)[1:] for r in contamination(d, b, block_words=12).collect()}
    assert got == {i: brute_contamination(t, items, 10) for i, t in enumerate(texts)}
    out = decontaminate(d.repartition(2), b, block_words=12)
    assert out.columns == d.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == 120 and all((r.hit_spans, r.hit_items, r["items"]) == ("a", i, ["b"]) for i, r in rows.items())
    assert not any(r.contaminated for r in contamination(out, b).collect()) and all(f"own{i}x39" in r.text for i, r in rows.items())


def test_decontaminated_texts_have_no_hits_left_and_clean_ones_stay(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven")]
    clean = "nothing of that kind here, one two three"
    rows = [(1, f"{clean}. ONE two, three four five six seven eight nine ten! And {clean} {clean}", "en", "s", 9), (2, clean, "en", "s", 9), (3, items[0][1], "en", "s", 9), (4, None, None, None, None), (4, "", "", "", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(decontaminate(d, b, length_col="n_chars").collect(), key=lambda r: (r.doc_id, r.text is not None))
    assert [r.doc_id for r in got] == [1, 2, 4, 4]
    assert got[0].text == f"{clean}. ! And {clean} {clean}" and got[0].n_chars == len(got[0].text)
    assert tuple(got[1]) == rows[1] and got[2].text is None and got[3].text == ""


def test_cut_spans():
    assert words("A-b É") == [b"a", b"b", "É".encode()]
    assert cut_spans("é a, b. c!", [(1, 3)]) == "é . c!"


def brute_longest(w):
    best = [0] * len(w)
    for i in range(len(w)):
        for j in range(len(w)):
            if i != j:
                k = 0
                while i + k < len(w) and j + k < len(w) and w[i + k] == w[j + k]:
                    k += 1
                best[i] = max(best[i], k)
    return best


def test_longest_repeats_equal_brute_force():
    rng = random.Random(9)
    for _ in range(60):
        texts = [[rng.randint(0, rng.choice([1, 3, 9])) for _ in range(rng.randint(0, 30))] for _ in range(rng.randint(1, 6))]
        flat = [x for t in texts for x in t]
        if flat:
            got = longest_repeats(np.asarray(flat, np.int64), np.cumsum([len(t) for t in texts]))
            assert list(got) == [x for t in texts for x in brute_longest(t)]


def brute_rules(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    repeat = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    long = brute_longest(w)
    cover = {i + k for i, n in enumerate(long) if n >= 4 for k in range(n)}
    failed = len(w) < 20 or 100 * len(repeat) > 30 * len(w)
    most = max([n for n in long if n >= 4], default=0)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat), len(cover), most, failed, not failed and len(cover) <= 0.3 * len(w) and most <= 200


def test_rules_equal_brute_force(spark):
    rng = random.Random(4)
    say = lambda k, n: " ".join(f"w{rng.randint(0, n)}" + rng.choice(["", "\n", "\t", "#", "é|"]) for _ in range(k))
    docs = [say(rng.randint(0, 80), rng.choice([2, 20, 5000])) for _ in range(80)]
    docs += [None, "", " \n\n", "a b\na b\n a b\n", (say(30, 5000) + "\n") * 3, say(40, 9999) + (" x y z w v u" * 15), "one　two\x1cthree " * 12, say(300, 9999) + " " + "long run " * 120]
    d = spark.createDataFrame([(i, t, 3) for i, t in enumerate(docs)], "doc_id long, text string, n_words int")
    got = {r.doc_id: tuple(r)[1:] for r in repetition_rules(d).collect()}
    assert got == {i: brute_rules(t) for i, t in enumerate(docs)}
    assert repetition_rules(d.limit(0)).count() == 0
