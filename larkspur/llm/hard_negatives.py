"""Hard negatives by a pivot table.

Vectors are scaled to integers, so that scores (inner products) are exact.  Each row gets one more coordinate
that brings all rows to the same norm, and an anchor gets a zero there: their distance then falls as their score grows
(``|a-x|^2 = |a|^2 + M^2 - 2 score``).  The pivot table holds each row's distances to a few pivots; by the
triangle inequality they bracket the distance to an anchor, and so the score.  Rows are kept in the order
of their nearest pivot, so that whole slices are ruled out by their ranges first, then rows by their own
distances, and only what is left is multiplied.

Anchors come in blocks of a bounded size, each of which passes the table twice: once for the positives and once for the
negatives of the score windows that the positives give.  A task keeps the best few of each anchor, so
what it sends on does not depend on how many rows it reads, nor on how many share a label or a vector.
"""

from __future__ import annotations

from math import inf

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, new_path, table
from .merkle_manifest import indexed

#: Pivots, rows that they are chosen from, anchors of a block, rows of a slice.
PIVOTS, PIVOT_SAMPLE, BLOCK, SLICE = 16, 1024, 2048, 512
#: Above this squared norm scores might not fit 64 bits; up to the second, products of doubles are exact.
_LONGEST, _EXACT = float(1 << 62), float(1 << 52)


def scaled_rows(rows: DataFrame, id_col: str, vec_col: str, label: Column, scale: int) -> DataFrame:
    """``vec_id, label, v, norm`` of the rows that take part; v has ``floor(scale * x)`` of the components as doubles."""
    v = F.col(f"`{vec_col}`")
    fit = F.forall(v, lambda x: F.coalesce((F.abs(x.cast("double")) < inf) & ~F.isnan(x), F.lit(False)))
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.pow(F.floor(x.cast("double") * scale).cast("double"), F.lit(2.0)))
    # the bound goes first: floor of a larger double would not fit either
    bound = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.pow(F.abs(x.cast("double")) * scale + 1, F.lit(2.0)))
    known = rows.where(F.col(f"`{id_col}`").isNotNull() & label.isNotNull() & v.isNotNull()).where(fit).where(bound < _LONGEST)
    return known.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"), norm.alias("norm"))


def _matrix(column, width: int):
    """A list column as rows of one width; shorter vectors are filled up with zeros."""
    import numpy as np

    sizes = column.value_lengths().to_numpy()
    out, flat = np.zeros((len(sizes), width), np.int64), column.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _pivots(rows: list, width: int, top: float, count: int):
    """(pivots, the coordinate that each has besides): farthest first among the sampled rows, from the longest."""
    import numpy as np

    x = np.zeros((len(rows), width))
    for k, row in enumerate(rows):
        x[k, : len(row)] = row
    more = np.sqrt(np.maximum(top - (x * x).sum(1), 0))
    chosen, far = [], np.full(len(x), inf)
    while len(x) and len(chosen) < count:
        k = int(np.argmin(more) if not chosen else np.argmax(far))
        if far[k] == 0:
            break
        chosen.append(k)
        far = np.minimum(far, ((x - x[k]) ** 2).sum(1) + (more - more[k]) ** 2)
    return x[chosen], more[chosen]


def pivot_table(rows: DataFrame, held: Scratch, pivots: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> tuple[DataFrame, dict]:
    """(``vec_id, label, v, norm, near, dist``, what the table rests on).  Pivots are picked from the ``sample``
    rows whose ids have the smallest hashes; any choice gives the same results.  Sorted by nearest pivot and distance."""
    count, top, width = rows.agg(F.count("*"), F.max("norm"), F.max(F.size("v"))).first()
    top, width = float(top or 0), int(width or 0)
    chosen, more = _pivots([r[0] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "v").limit(sample).select("v").collect()], width, top, pivots)

    def distances(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x, norm = _matrix(batch.column(2), width), batch.column(3).to_numpy()
            own = np.sqrt(np.maximum(top - norm, 0))
            d = np.sqrt(np.maximum(2 * top - 2 * (x.astype(float) @ chosen.T) - 2 * own[:, None] * more, 0))
            near = d.argmin(1) if len(d) else np.zeros(0, np.int64)
            packed = [pa.array([row.tobytes() for row in m], pa.binary()) for m in (x, d)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed[0], pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near]), packed[1]], ["vec_id", "label", "v", "near", "gap", "dist"])

    far = rows.select("vec_id", "label", "v", "norm").mapInArrow(distances, "vec_id long, label long, v binary, near int, gap double, dist binary")
    parts = max(1, min(-(-count // 4096), 4 * rows.sparkSession.sparkContext.defaultParallelism))
    placed = held.write(far.repartitionByRange(parts, "near", "gap", "vec_id").sortWithinPartitions("near", "gap", "vec_id"), "pivot_table")
    return placed, {"pivots": chosen, "more": more, "top": top, "width": width, "exact": top < _EXACT}


class _Block:
    """A block of anchors (ids, labels, vectors) with what the pivot table says of them."""

    def __init__(self, basis: dict, anchors):
        import numpy as np

        self.basis = basis
        self.ids, self.labels, x = anchors
        self.x = x.astype(float) if basis["exact"] else x
        self.norm = (x.astype(float) ** 2).sum(1)
        d2 = self.norm[:, None] + basis["top"] - 2 * (x.astype(float) @ basis["pivots"].T)
        self.dist = np.sqrt(np.maximum(d2, 0))
        # distances are rounded, mostly where they are small: the slack covers it many times over
        self.loose = 1e-7 * (np.sqrt(basis["top"]) + np.sqrt(self.norm)) + 1e-9

    def _least(self, gap, rows):
        """The greatest score that a distance of at least ``gap`` allows."""
        import numpy as np

        gap = np.maximum(gap - self.loose[rows], 0)
        whole = self.norm[rows] + self.basis["top"]
        return (whole - gap * gap) / 2 + 1e-9 * whole + 1

    def _most(self, gap, rows):
        gap, whole = gap + self.loose[rows], self.norm[rows] + self.basis["top"]
        return (whole - gap * gap) / 2 - 1e-9 * whole - 1

    def left(self, dist, floor, ceiling):
        """(anchors, mask of rows) that the brackets leave: those whose score may be in floor to ceiling."""
        import numpy as np

        every = np.arange(len(self.ids))
        low, high = dist.min(0), dist.max(0)
        near, far = np.zeros(len(every)), np.full(len(every), inf)
        for j in range(dist.shape[1]):
            a = self.dist[:, j]
            near = np.maximum(near, np.maximum(a - high[j], low[j] - a))
            far = np.minimum(far, a + high[j])
        some = np.flatnonzero((self._least(near, every) >= floor) & (self._most(far, every) <= ceiling))
        near, far = np.zeros((len(some), len(dist))), np.full((len(some), len(dist)), inf)
        for j in range(dist.shape[1]):
            a, x = self.dist[some, j][:, None], dist[:, j]
            np.maximum(near, np.abs(a - x), out=near)
            np.minimum(far, a + x, out=far)
        at = some[:, None]
        return some, (self._least(near, at) >= floor[at]) & (self._most(far, at) <= ceiling[at])

    def scores(self, some, mask, x):
        """(exact scores of the masked pairs, the value that the others have instead)."""
        import numpy as np

        used = np.flatnonzero(mask.any(0))
        kind, least = (float, -inf) if self.basis["exact"] else (np.int64, np.iinfo(np.int64).min)
        out = np.full(mask.shape, least, kind)
        if len(used) and len(some):
            out[:, used] = self.x[some] @ x[used].astype(self.x.dtype).T
        out[~mask] = least
        return out, least


def _slices(batches, basis: dict, size: int):
    import numpy as np

    for batch in batches:
        n = batch.num_rows
        ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64).reshape(n, basis["width"])
        dist = np.frombuffer(b"".join(batch.column(3).to_pylist()), float).reshape(n, len(basis["pivots"]))
        for k in range(0, n, size):
            yield ids[k : k + size], labels[k : k + size], x[k : k + size], dist[k : k + size]


class _Best:
    """The ``keep`` first, by score and then smaller id, of a number of lists.  ``last``: what a score must
    reach to get on a list."""

    def __init__(self, lists: int, keep: int):
        import numpy as np

        self.keep, self.last = keep, np.full(lists, -inf)
        self.which, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, which, scores, allowed, ids) -> None:
        """``scores``: one row for each of the lists ``which``; those ``allowed`` are offered to it."""
        import numpy as np

        allowed &= scores >= self.last[which][:, None]
        if not allowed.any():
            return
        if scores.shape[1] > self.keep:  # no more than the first few of the slice, and what ties with them
            held = np.where(allowed, scores, scores.min())
            allowed &= scores >= np.partition(held, -self.keep, axis=1)[:, -self.keep][:, None]
        r, c = np.nonzero(allowed)
        which, score, ids = np.concatenate([self.which, which[r]]), np.concatenate([self.score, scores[r, c].astype(np.int64)]), np.concatenate([self.id, ids[c]])
        order = np.lexsort((ids, -score, which))
        which = which[order]
        place = np.arange(len(which)) - np.searchsorted(which, which)
        order, which, place = order[place < self.keep], which[place < self.keep], place[place < self.keep]
        self.which, self.score, self.id = which, score[order], ids[order]
        full = place == self.keep - 1
        self.last[which[full]] = self.score[full]


def _positives(block: _Block, keep: int, size: int):
    """The first ``keep`` rows of each anchor's label with other ids: (a, k, vec_id, score), k always 0."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        b, best = block.value, _Best(len(block.value.ids), keep)
        for ids, labels, x, dist in _slices(batches, b.basis, size):
            some, mask = b.left(dist, best.last, np.full(len(b.ids), inf))
            mask &= (b.labels[some][:, None] == labels) & (b.ids[some][:, None] != ids)
            scores, _ = b.scores(some, mask, x)
            best.add(some, scores, mask, ids)
        yield pa.RecordBatch.from_arrays([pa.array(best.which), pa.array(np.zeros(len(best.which), np.int32)), pa.array(best.id), pa.array(best.score)], ["a", "k", "vec_id", "score"])

    return run


def _negatives(block: _Block, windows, keep: int, size: int):
    """The first ``keep`` rows of other labels in each window: (a, k, vec_id, score).  ``windows``: for each
    anchor and k the least and the greatest score, as two matrices."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        b, (low, high) = block.value, windows.value
        m, k = low.shape
        best = _Best(m * k, keep)
        ceiling = np.where(low <= high, high, -inf).max(1, initial=-inf)
        for ids, labels, x, dist in _slices(batches, b.basis, size):
            floor = np.where(low <= high, np.maximum(low, best.last.reshape(m, k)), inf).min(1, initial=inf)
            some, mask = b.left(dist, floor, ceiling)
            mask &= b.labels[some][:, None] != labels
            scores, _ = b.scores(some, mask, x)
            for j in range(k):
                best.add(some * k + j, scores, mask & (scores >= low[some, j][:, None]) & (scores <= high[some, j][:, None]), ids)
        yield pa.RecordBatch.from_arrays([pa.array(best.which // k), pa.array((best.which % k).astype(np.int32)), pa.array(best.id), pa.array(best.score)], ["a", "k", "vec_id", "score"])

    return run


def _first(found: DataFrame, keep: int) -> DataFrame:
    """The first few of each list over all tasks; each task sent no more than as many."""
    order = Window.partitionBy("a", "k").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def hard_negatives(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | str = "label", scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
    pivots: int = PIVOTS, sample: int = PIVOT_SAMPLE, block: int = BLOCK, size: int = SLICE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows where ``anchor``, a condition on ``vec_id``, holds.  An anchor's positives are the first rows of
    its label under other ids; for each, the first rows of other labels follow whose score is within ``low``
    and ``high`` per cent of the positive's.  First: of higher score, then of smaller id.

    Rows with a null id, label or vector, or a null or non-finite component, take no part, nor do those whose
    scaled squared norm is 2^62 or more (scores are 64-bit).  Shorter vectors count as filled up with zeros, an
    empty one has the score 0 with all.  Rows that repeat an id or a vector each take part, as anchors too.
    Without anchors, positives or rows in a window there are no result rows.  Other columns are not read.
    """
    import numpy as np

    spark, held = rows.sparkSession, Scratch()
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    scaled = held.write(scaled_rows(rows, id_col, vec_col, label, scale), "scaled")
    places, basis = pivot_table(scaled, held, pivots, sample)
    held.drop(scaled)
    anchors = held.write(indexed(places.where(anchor).select("vec_id", "label", "v"), [], ["vec_id", "label", "v"], held), "anchors")
    total = (anchors.select("total").first() or [0])[0]
    places = places.select("vec_id", "label", "v", "dist")
    found, schema, out = "a long, k int, vec_id long, score long", "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long", new_path(spark, "negatives")
    spark.createDataFrame([], schema).write.parquet(f"{out}/block=-1")
    for start in range(0, total, block):
        some = anchors.where(F.col("idx").between(start, start + block - 1)).orderBy("idx").select("vec_id", "label", "v").collect()
        x = np.frombuffer(b"".join(r[2] for r in some), np.int64).reshape(len(some), basis["width"])
        own = spark.sparkContext.broadcast(_Block(basis, (np.asarray([r[0] for r in some]), np.asarray([r[1] for r in some]), x)))
        best = _first(places.mapInArrow(_positives(own, positives, size), found), positives).collect()
        floor, ceiling = np.full((len(some), positives), 1, np.int64), np.zeros((len(some), positives), np.int64)  # empty windows
        for r in best:
            floor[r.a, r.rank - 1], ceiling[r.a, r.rank - 1] = -(-low * r.score // 100), min(high * r.score // 100, 1 << 62)
        windows = spark.sparkContext.broadcast((floor, ceiling))
        pairs = spark.createDataFrame([(r.a, r.rank - 1, some[r.a][0], r.vec_id, r.score) for r in best], "a long, k int, anchor_id long, positive_id long, positive_score long")
        chosen = _first(places.mapInArrow(_negatives(own, windows, negatives, size), found), negatives)
        # pairs: at most block * positives rows
        chosen.join(F.broadcast(pairs), ["a", "k"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{out}/block={start}")
        own.unpersist()
        windows.unpersist()
    return spark.read.schema(schema).parquet(out).select(*[c.split()[0] for c in schema.split(", ")])


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of all embeddings; anchors
    are the rows whose id is divisible by 100, and ids divisible by 7 have the next label instead of theirs."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


#: The same by plain means: every anchor against every row.
OP11_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS a, r.vec_id AS b, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score FROM r AS a, r WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b, score FROM s WHERE same AND a <> b QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) QUALIFY row_number() OVER w <= 5
"""
