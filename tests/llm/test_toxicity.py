import random

import numpy as np

from larkspur.llm.toxicity import fit, fit_rows, held_out, label_model, toxicity_scores, word_features


def corpus(n=1500, seed=1):
    rng = random.Random(seed)
    say = lambda: "".join(rng.choice("abdeimnorst") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        w, toxic = [say() for _ in range(rng.randint(3, 60))], rng.random() < 0.15
        if toxic:
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(["Vilezog", "vilezag!", "zurk", "vilezo" + say()])
        rows.append((i, " ".join(w), "en", 0.5))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    rows += [(None, "zurk", "en", 0.0), (5000, None, None, None), (5001, "", None, None), (5002, "zurk zurk vilezoa", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    marks = spark.createDataFrame([*labels, (None, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity_scores(docs, marks).collect()
    assert len(got) == len(rows)
    truth = {i: y for i, _, y in labels}
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(out) > 200 and np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[5002].predicted == 1 and by[5000].score == by[5001].score < 0.5 and by[5000].predicted == 0
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity_scores(docs, none).collect()} == {0.5}
    assert toxicity_scores(docs.limit(0), none).count() == 0


def test_held_out_rows(spark):
    import zlib

    got = spark.range(200).select("id", held_out(__import__("pyspark").sql.functions.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_label_model_mends_wrong_labels_and_weighs_copies_once():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    votes = np.column_stack([np.where(y, rng.random(4000) < 0.8, rng.random(4000) < 0.03) for _ in range(6)])
    votes = np.column_stack([votes, votes[:, 0], votes[:, 0], votes[:, 0]])
    labels = np.where(rng.random(4000) < 0.05, ~y, y).astype(float)
    model = label_model(votes, labels)
    assert np.mean((model.posterior > 0.5) == y) > 0.985
    assert model.weight[0] < 0.35 and model.weight[1] > 0.7


def test_word_features():
    assert len(word_features(b"abc")) == 1 and len(set(word_features(b"abcdefgh"))) == 4
    assert fit_rows([], []).weights == {}


def test_lexicon_is_of_all_labelled_rows(spark):
    """Toxic words that no sampled row has are known all the same."""
    rows, labels = corpus(1500, seed=3)
    first = 10_000
    rare = [(first + i, f"{rows[i][1]} {'grulk' if i % 2 else 'morvagish'}", "en", 0.5) for i in range(40)]
    labels += [(i, 0, 1) for i, *_ in rare]
    ids = spark.createDataFrame([(i,) for i, *_ in labels], "id long")
    F = __import__("pyspark").sql.functions
    sampled = {r.id for r in ids.where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(300).collect()}
    rare = [r for r in rare if r[0] not in sampled]
    assert len(rare) > 20
    docs = spark.createDataFrame([*rows, *rare], "doc_id long, text string, lang string, score double")
    model = fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), sample_rows=300)
    texts = spark.createDataFrame([(1, "see the grulk here"), (2, "a morvagish one"), (3, "see the one here")], "doc_id long, text string")
    assert [r.score >= 0.5 for r in model.score(texts).orderBy("doc_id").collect()] == [True, True, False]
