"""Toxicity by weak supervision: a label model over many voters, and a linear classifier on its posterior.

Voters come from all training rows, counted in a distributed aggregate: words (lexicon voters) and word beginnings (pattern voters) that lean
to the toxic class vote for it, and voters that find nothing of their part of the lexicon vote against it.
The given label is one more voter.  A generative model (class prior, and for each voter how often it votes
in either class) is fitted by expectation maximisation.  Voters that agree beyond what the class explains
are correlated; a voter counts by one over its summed squared correlation, so that a family of voters that
say the same counts about once.  The posterior of a bounded sample of the rows trains a logistic regression
on words and word beginnings, and that scores whole texts; features that no sampled row has are weighted by
their counts over all training rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, each, let_go, materialise, table
from .decontaminate import words

#: Lengths in bytes of the word beginnings that are features besides whole words.
BEGINNINGS = (4, 5, 6)
#: The weights are fitted on at most so many labelled rows, the first by a hash of the id; the lexicon is of all.
SAMPLE_ROWS = 8_000
MAX_VOTERS, MAX_FEATURES = 300, 6_000
CLEAN_VOTERS = 5


def word_features(word: bytes) -> list[int]:
    """Feature numbers of one lower-case word: the word, and each longer word's beginnings."""
    return [crc32(b"w" + word), *(crc32(b"b" + word[:n]) for n in BEGINNINGS if len(word) > n)]


def text_words(text: str | None) -> set[bytes]:
    return set(words(text.lower())) if text else set()


@dataclass
class LabelModel:
    """What expectation maximisation found: per voter P(vote | toxic), P(vote | clean) and weight."""

    prior: float
    hit: object
    false: object
    weight: object
    posterior: object


def label_model(votes, labels, rounds: int = 25) -> LabelModel:
    """votes: rows x voters, true where a voter votes; labels: the voter that always votes (0 or 1)."""
    import numpy as np

    v = np.column_stack([votes, labels]).astype(np.float32)
    q = np.clip(labels.astype(float), 0.02, 0.98)
    weight = np.ones(v.shape[1])
    for turn in range(rounds):
        prior = float(np.clip(q.mean(), 1e-4, 1 - 1e-4))
        hit, false = ((v.T @ c + 0.1) / (c.sum() + 1) for c in (q, 1 - q))
        if turn in (0, rounds // 2):
            # correlations within the classes: of what is left of each vote when its mean in the class is gone
            left = v - np.outer(q, hit) - np.outer(1 - q, false)
            spread = np.sqrt((left**2).mean(0)) + 1e-6
            rho = (left.T @ left) / len(v) / np.outer(spread, spread)
            weight = 1 / np.maximum(1, (np.where(np.abs(rho) > 0.1, rho, 0) ** 2).sum(1))
        on = weight * (np.log(hit) - np.log(false))
        off = weight * (np.log1p(-hit) - np.log1p(-false))
        odds = v @ (on - off) + off.sum() + np.log(prior / (1 - prior))
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return LabelModel(prior, hit, false, weight, q)


class Rows:
    """A sparse 0/1 matrix: the feature columns of each row, flat, with the rows' bounds."""

    def __init__(self, columns, row_of, rows: int):
        self.columns, self.row_of, self.rows = columns, row_of, rows

    def sums(self, weights):
        import numpy as np

        return np.bincount(self.row_of, weights[self.columns], self.rows)

    def back(self, values, width: int):
        import numpy as np

        return np.bincount(self.columns, values[self.row_of], width)


def logistic(rows: Rows, width: int, target, penalty: float = 0.1, rounds: int = 500):
    """(weights, bias) of the logistic regression on soft targets, by accelerated gradient descent with
    steps scaled by each feature's frequency."""
    import numpy as np

    w, b = np.zeros(width), float(np.log((target.mean() + 1e-3) / (1.001 - target.mean())))
    n = rows.rows
    scale = 1 / (0.25 * rows.back(np.ones(n), width) + penalty)
    vw, vb = w.copy(), b
    lean = 1.0 / max(1.0, np.median(np.bincount(rows.row_of, minlength=n)) ** 0.5)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows.sums(vw) + vb, -30, 30)))
        gap = p - target
        new_w = vw - lean * 0.5 * scale * (rows.back(gap, width) + penalty * vw)
        new_b = vb - lean * gap.mean()
        beta = min(0.95, k / (k + 3))
        vw, vb = new_w + beta * (new_w - w), new_b + beta * (new_b - b)
        w, b = new_w, new_b
    return w, b


@dataclass
class Model:
    """A fitted scorer: weights by feature number, and the bias."""

    weights: dict[int, float]
    bias: float

    def score(self, docs: DataFrame, text_col: str = "text", out: str = "score") -> DataFrame:
        """``docs`` with a score from 0 to 1 as one more column, without a shuffle.  Null and empty
        texts get the score of a text without words."""
        import math

        import pyarrow as pa

        weights, bias = self.weights, self.bias
        names = docs.columns
        if out in names or len(set(names)) < len(names):
            raise ValueError(f"columns with equal names: {[*names, out]}")
        at = names.index(text_col)

        def run(batches):
            let_go()
            memo = Memo(lambda word: tuple(f for f in word_features(word) if f in weights), 150_000)
            for batch in batches:
                scores = []
                for text in each(batch.column(at)):
                    found = {f for fs in map(memo.__getitem__, text_words(text)) if fs for f in fs}
                    odds = bias + math.fsum(weights[f] for f in found)
                    scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*names, out])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
        return docs.mapInArrow(run, f"{schema}, `{out}` double")


@dataclass
class Lexicon:
    """Features by number, with the rows and toxic rows that have each, and how many features a word of
    each has; and the rows and toxic rows that were counted."""

    found: object
    count: object
    bad: object
    kin: object
    rows: int
    toxic: int


def lexicon_of(rows: DataFrame) -> Lexicon:
    """The leaning features of all of ``rows`` (y, text): those that can be voters or the classifier's."""
    import pyarrow as pa

    names = ["f", "n", "bad", "kin"]

    def count(batches):
        let_go()
        total, bad, kin = Counter(), Counter(), {}

        def known(word):
            fs = word_features(word)
            for f in fs:
                kin[f] = max(kin.get(f, 0), len(fs))
            return fs

        def flush():
            out = [list(total), list(total.values()), [bad[f] for f in total], [kin[f] for f in total]]
            for held in (total, bad, kin):
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

        memo, seen, toxic = Memo(known, 50_000), 0, 0
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), each(batch.column(1)), strict=True):
                found = {f for fs in map(memo.__getitem__, text_words(text)) for f in fs}
                total.update(found)
                if y:
                    bad.update(found)
                seen, toxic = seen + 1, toxic + y
                if len(total) > 200_000:
                    yield flush()
                    memo = Memo(known, 50_000)
        yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()) for c in (-1, seen, toxic, 0)], names)

    counts = rows.select("y", "text").mapInArrow(count, "f long, n long, bad long, kin long")
    counts = counts.groupBy("f").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.max("kin").alias("kin"))
    counts = materialise(counts.where("n >= 3 OR f < 0"), "lexicon")
    n, toxic = next(iter(counts.where("f < 0").select("n", "bad").collect()), (0, 0))
    base = toxic / n if n else 0.0
    z = (F.col("bad") - base * F.col("n")) / F.sqrt(F.col("n") * base * (1 - base) + 1e-9)
    leaning = (F.col("bad") + 1) / (F.col("n") + 2) > max(0.5, 3 * base) if base < 0.3 else F.col("z") > 3
    known = counts.where("f >= 0").withColumn("z", z)
    # two bounded results: what is strongest either way, and the strongest of those that can vote
    some = [known.orderBy(F.desc(F.abs("z")), "f").limit(MAX_FEATURES), known.where(leaning & (F.col("n") >= 4)).orderBy(F.desc("z"), "f").limit(MAX_VOTERS)]
    got = pa.concat_tables([s.select(names).toArrow() for s in some]).group_by("f").aggregate([(c, "max") for c in names[1:]]).sort_by("f")
    columns = [got.column(c).to_numpy() for c in ("f", "n_max", "bad_max", "kin_max")]
    return Lexicon(*columns, n, toxic)


def fit_rows(features: list, labels, lexicon: Lexicon | None = None) -> Model:
    """features: one integer array a row; labels: 0 or 1 a row.  Without a lexicon it is that of the rows."""
    import numpy as np

    labels = np.asarray(labels, float)
    rows = len(labels)
    n, toxic = (lexicon.rows, float(lexicon.toxic)) if lexicon else (rows, float(labels.sum()))
    if not n or toxic in (0.0, float(n)):
        share = (toxic + 0.5) / (n + 1)
        return Model({}, float(np.log(share / (1 - share))))
    sizes = np.asarray([len(f) for f in features], int)
    row_of = np.repeat(np.arange(rows, dtype=np.int32), sizes)
    flat = np.concatenate(features) if sizes.sum() else np.zeros(0, np.uint32)
    if lexicon:
        found, count, bad, kin = lexicon.found, lexicon.count, lexicon.bad, lexicon.kin
        own = np.isin(flat, found)
        row_of, columns = row_of[own], np.searchsorted(found, flat[own]).astype(np.int32)
    else:
        found, columns = np.unique(flat, return_inverse=True)
        columns = columns.astype(np.int32)
        count, kin = np.bincount(columns, minlength=len(found)), np.ones(len(found))
        bad = np.bincount(columns, labels[row_of], minlength=len(found))
    base = toxic / n
    z = (bad - base * count) / np.sqrt(count * base * (1 - base) + 1e-9)

    # voters: the strongest leaning features
    lean = np.flatnonzero((count >= 4) & ((bad + 1) / (count + 2) > max(0.5, 3 * base) if base < 0.3 else (count >= 4) & (z > 3)))
    lean = lean[np.argsort(-z[lean], kind="stable")][:MAX_VOTERS]
    voter = np.full(len(found), -1)
    voter[lean] = np.arange(len(lean))
    votes = np.zeros((rows, len(lean) + CLEAN_VOTERS), bool)
    on = voter[columns] >= 0
    votes[row_of[on], voter[columns[on]]] = True
    for k in range(CLEAN_VOTERS):
        votes[:, len(lean) + k] = ~votes[:, : len(lean)][:, k::CLEAN_VOTERS].any(1)

    # the classifier's features: those that lean most to either class
    use = np.flatnonzero(count >= 3)
    use = use[np.argsort(-np.abs(z[use]), kind="stable")][:MAX_FEATURES]
    number = np.full(len(found), -1)
    number[use] = np.arange(len(use))
    own = number[columns] >= 0
    w, b = np.zeros(len(use)), float(np.log(base / (1 - base)))
    prior, seen = b, np.bincount(number[columns[own]], minlength=len(use)) > 0
    if rows:
        w, b = logistic(Rows(number[columns[own]], row_of[own], rows), len(use), label_model(votes, labels).posterior)
    # what no sampled row has goes by its counts: log odds against the prior, and for voters against the
    # bias, so that a text with such a word alone is as toxic as its rows; shared among a word's features
    by_count = (np.log((bad[use] + 0.5) / (count[use] - bad[use] + 0.5)) - np.where(voter[use] >= 0, b, prior)) / kin[use]
    w = np.where(seen, w, by_count)
    return Model({int(f): float(x) for f, x in zip(found[use], w, strict=True) if abs(x) > 1e-4}, b)


def held_out(doc_id) -> F.Column:
    """Whether a row is held out: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """The scorer from the labelled rows that are not held out: the lexicon from all, the weights from at
    most ``sample_rows`` of them.

    Rows with a null id, label or text do not count; an id that is labelled more than once has its
    larger label; an id with several texts counts with each.  Without rows of both classes every text
    gets the share of the one class as its score.
    """
    import numpy as np
    import pyarrow as pa

    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    # the labels grow with the texts, so they are not broadcast; a hash join sorts no texts
    lexicon = lexicon_of(texts.join(known.hint("shuffle_hash"), "id"))
    rows = texts.join(F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)), "id").select("id", "y", "text")
    own = frozenset(lexicon.found.tolist())

    def features(batches):
        let_go()
        memo = Memo(lambda word: tuple(f for f in word_features(word) if f in own), 50_000)
        for batch in batches:
            out = [np.asarray(sorted({f for fs in map(memo.__getitem__, text_words(t)) for f in fs}), np.uint32).view(np.int32) for t in each(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["id", "y", "features"])

    kind = rows.schema["id"].dataType.simpleString()
    got = rows.mapInArrow(features, f"id {kind}, y int, features array<int>").toArrow().sort_by("id")
    lists = got.column("features").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint32)
    return fit_rows([flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], got.column("y").to_numpy(), lexicon)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``; see ``fit`` and ``Model.score``."""
    model = fit(docs, labels, id_col, text_col)
    scored = model.score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of all documents, by a model of the labelled ones that are not held out; null
    and empty texts are scored as texts without any feature."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
