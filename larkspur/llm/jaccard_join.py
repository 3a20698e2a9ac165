"""N-gram Jaccard self-join: size-banded tiles, hashed bitmap signatures, exact intersection.

1. Each text becomes its sorted set of 64-bit shingle hashes (shingles are told apart by these alone); texts
   with equal sets are one class from then on, with a number of its own.
2. A set's prefix, its first n - ceil(t n) + 1 shingles in one common order, meets the prefix of every set
   that it links with; of the smaller set of a link the first n - ceil(2 t n / (1 + t)) + 1 do.  A tile holds
   the sets with one prefix shingle, sorted by size; within it only sets of one size band (sizes in the ratio
   t) meet.  Rare shingles come first in the order, so tiles are small; which shingles are frequent is
   counted over all texts, and only speed depends on that list.
3. Every candidate pair passes the bitmap test: with one bit per hashed shingle, the bits that only one set
   has are shingles that the other lacks, which bounds the overlap from above.
4. What is left is intersected exactly.  A first round tests each set against its most central partner
   (whose prefix is made of frequent shingles: a text that others are edited from); a pair whose sets are
   connected by then needs no test, so a large group of near copies costs no quadratic work.

Tiles with more than ``TILE`` sets emit no pairs in the first round but a star around their most central
set.  After it only sets of different components in such a tile still meet: in blocks of at most ``BLOCK``
sets and ``BLOCK_BYTES`` of bitmaps a side, by the bitmap test alone, of which only the pairs that pass come
out.  Whole texts move only for the pairs that are intersected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, each, free_name, let_go, table
from .components import components

TILE, BLOCK, BLOCK_BYTES = 16, 2048, 1 << 25
#: Frequent shingles that the order knows of; the rest count as rare.  Bounds what is broadcast.
FREQUENT = 200_000
#: Texts of at most so many sets are looked up by a broadcast of their places, 24 bytes each; more meet in a shuffle.
PLACES = 500_000


def shingles(text: str | None, k: int):
    """Sorted distinct 64-bit hashes of the k-word runs of a text; of all its words if they are fewer."""
    import numpy as np
    import xxhash

    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    k = min(k, len(w))
    n = len(w) - k + 1
    h = np.full(n, (k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(k):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + w[i : i + n]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ (h >> np.uint64(29)))


def bitmap(hashes):
    """Bits by hash, a power of two of them, at least four times the set's size and 64."""
    import numpy as np

    width = max(64, 1 << (4 * max(1, len(hashes)) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(hashes & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


def _folded(bits, size: int):
    while len(bits) > size:
        half = len(bits) // 2
        bits = bits[:half] | bits[half:]
    return bits


def overlap_bound(na: int, a: bytes, nb: int, b: bytes) -> int:
    """No fewer than the shingles that two sets share."""
    import numpy as np

    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    x, y = _folded(x, size), _folded(y, size)
    return min(na - int(np.bitwise_count(x & ~y).sum()), nb - int(np.bitwise_count(y & ~x).sum()))


def _frequent(rows: DataFrame, k: int):
    """(shingle, texts that hold it) of the most frequent shingles over all texts, sorted by shingle."""
    import numpy as np
    import pyarrow as pa

    def summed(parts):
        h, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        h, at = np.unique(h, return_inverse=True)
        return h, np.bincount(at, c, len(h)).astype(np.int64)

    def count(batches):
        let_go()
        held, size = [], 0

        def close():
            h, c = summed(held)
            some = c >= 4
            return pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(c[some])], ["h", "c"])

        for batch in batches:
            sets = [shingles(t, k) for t in each(batch.column(0))]
            if sets:
                h, c = np.unique(np.concatenate(sets), return_counts=True)
                held.append((h[c > 1], c[c > 1]))
                size += len(held[-1][0])
            if size > 2_000_000:
                yield close()
                held, size = [], 0
        if held:
            yield close()

    found = rows.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where("c >= 8").orderBy(F.desc("c"), "h").limit(FREQUENT).toArrow()
    h, c = (found.column(x).to_numpy() for x in ("h", "c"))
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], c[order]


def _signatures(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """A row per row of (doc_id, t, text): the set's size, 128-bit digest (null if empty), prefix in rare
    and frequent shingles (with how many of each are in the prefix as a smaller set), and bitmap.  t tells
    texts of one id apart."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    frequent = rows.sparkSession.sparkContext.broadcast(_frequent(rows, k))

    def sign(batches):
        let_go()
        often, counts = frequent.value
        for batch in batches:
            out = []
            for text in each(batch.column(2)):
                s = shingles(text, k)
                n = len(s)
                if not n:
                    out.append((0, None, None, 0, None, 0, None))
                    continue
                size, inner = n + 1 + (-percent * n // 100), n + 1 + (-2 * percent * n // (100 + percent))
                at = np.minimum(np.searchsorted(often, s), max(len(often) - 1, 0))
                c = np.where(often[at] == s, counts[at], 0) if len(often) else np.zeros(n, np.int64)
                first = np.lexsort((s, c))[:size]
                many = c[first] > TILE
                tokens = s[first].view(np.int64)
                inside = int(many[:inner].sum())
                out.append((n, xxhash.xxh3_128_digest(s.tobytes()), tokens[~many], inner - inside, tokens[many], inside, bitmap(s).tobytes()))
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds))], ["doc_id", "t", "n", "node", "few", "few_in", "many", "many_in", "bits"])

    return rows.mapInArrow(sign, "doc_id long, t long, n long, node binary, few array<long>, few_in int, many array<long>, many_in int, bits binary")


def _tiles(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the sets of each small tile that are of one size band and may have this shingle as
    their first common one; of a tile with more than TILE sets a row (token, a, m) each: m is twice the size, and one more where the shingle is not in the
    prefix that the set has as a smaller one."""
    import numpy as np
    import pyarrow as pa

    names = ["token", "a", "m", "b"]

    def large_rows(token, s, m):
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(s), pa.array(m), pa.nulls(len(s), pa.int64())], names)

    def pairs_of(token, s, m):
        """Of whole tiles, sorted by token and size."""
        edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
        big = np.repeat(np.diff(edge) > TILE, np.diff(edge))
        if big.any():
            yield large_rows(token[big], s[big], m[big])
        token, s, m = token[~big], s[~big], m[~big]
        n, inner, found = m >> 1, m & 1 == 0, []
        for step in range(1, TILE):
            x = np.flatnonzero((token[step:] == token[:-step]) & (100 * n[:-step] >= percent * n[step:]) & inner[:-step])
            if not len(x) and not (token[step:] == token[:-step]).any():
                break
            found.append((s[x], s[x + step]))
        if found:
            a, b = (np.concatenate(v) for v in zip(*found, strict=True))
            a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.nulls(len(a), pa.int64()), pa.array(b)], names)

    def run(batches):
        let_go()
        held, large = [np.zeros(0, np.int64)] * 3, None
        for batch in batches:
            rows = [batch.column(i).to_numpy() for i in range(3)]
            if large is not None:  # the tile that was found large goes on
                cut = int(np.searchsorted(rows[0], large, "right"))
                if cut:
                    yield large_rows(*(c[:cut] for c in rows))
                    rows = [c[cut:] for c in rows]
            rows = [np.concatenate(c) for c in zip(held, rows, strict=True)]
            if not len(rows[0]):
                held = rows
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut:
                yield from pairs_of(*(c[:cut] for c in rows))
            held, large = [c[cut:] for c in rows], None
            if len(held[0]) > TILE:
                large = held[0][0]
                yield large_rows(*held)
                held = [np.zeros(0, np.int64)] * 3
        if len(held[0]):
            yield from pairs_of(*held)

    return _prefix(sets, "few").repartition("token").sortWithinPartitions("token", "m", "s").mapInArrow(run, "token long, a long, m long, b long")


def _prefix(sets: DataFrame, kind: str) -> DataFrame:
    """(token, s, m) of the rare ("few") or frequent ("many") prefix shingles; m as in ``_tiles``."""
    tokens = sets.select(F.posexplode(kind).alias("i", "token"), "s", "n", f"{kind}_in")
    return tokens.select("token", "s", (2 * F.col("n") + (F.col("i") >= F.col(f"{kind}_in")).cast("long")).alias("m"))


def _bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the bitmap test leaves."""
    import pyarrow as pa

    def test(batches):
        let_go()
        for batch in batches:
            a, b, na, nb, x, y = (batch.column(i).to_pylist() for i in range(6))
            keep = [(100 + percent) * overlap_bound(na[i], x[i], nb[i], y[i]) >= percent * (na[i] + nb[i]) for i in range(len(a))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sides = [sets.select(F.col("s").alias(s), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"x{s}")) for s in "ab"]
    joined = pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b").select("a", "b", "na", "nb", "xa", "xb")
    return joined.mapInArrow(test, "a long, b long")


def _linked(pairs: DataFrame, places: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity, by exact intersection of the sorted arrays.
    ``places`` (s, d, h), a written table of the sets in pairs, tells where in ``rows`` a text of each is."""
    import numpy as np
    import pyarrow as pa

    def intersect(batches):
        let_go()
        for batch in batches:
            keep = []
            for x, y in zip(each(batch.column(2)), each(batch.column(3)), strict=True):
                s, t = shingles(x, k), shingles(y, k)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    places = F.broadcast(places) if places.count() <= PLACES else places
    texts = rows.join(places, F.expr("doc_id <=> d AND t = h")).groupBy("s").agg(F.first("text").alias("text"))
    sides = [texts.select(F.col("s").alias(s), F.col("text").alias(f"t{s}")) for s in "ab"]
    return pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b").select("a", "b", "ta", "tb").mapInArrow(intersect, "a long, b long")


def _central_pairs(pairs: DataFrame, central: DataFrame) -> DataFrame:
    """Of pairs (a, b) that of each set with its most central partner."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = both.join(central, F.col("b") == F.col("s")).groupBy("a").agg(F.max(F.struct("c", "b")).alias("m"))
    return best.select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b")).distinct()


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are not connected yet."""
    ends = pairs.alias("p").join(roots.alias("x"), F.expr("x.node = p.a"), "left").join(roots.alias("y"), F.expr("y.node = p.b"), "left")
    return ends.where("coalesce(x.root, p.a) <> coalesce(y.root, p.b)").select("p.a", "p.b")


def _across(large: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of one large tile and different components that pass the bitmap test."""
    import numpy as np
    import pyarrow as pa

    placed = large.alias("l").join(roots.alias("r"), F.expr("r.node = l.s"), "left").select("token", "s", "m", F.coalesce("r.root", "l.s").alias("root"))
    sizes = placed.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("c"), F.sum(F.shiftright("m", 1)).alias("size"), F.bool_or(F.col("m") % 2 == 0).alias("inner"))
    mixed = sizes.where("x <> y AND inner")
    # a block is a hash class of a tile's sets; each pair of blocks is a group.  A bitmap has a byte a shingle at most, but 8
    mixed = mixed.select("token", F.ceil(F.greatest(F.col("c") / BLOCK, (F.col("size") + 8 * F.col("c")) / BLOCK_BYTES)).cast("int").alias("k"))
    own = F.pmod(F.xxhash64("s"), F.col("k")).cast("int")
    rows = placed.join(mixed, "token").join(sets.select("s", "bits"), "s").withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "s", "m", "root", "bits")

    def meet(group: pa.Table) -> pa.Table:
        group = group.sort_by([("m", "ascending"), ("s", "ascending")])
        node, m, root, own = (group.column(c).to_numpy() for c in ("s", "m", "root", "own"))
        n, inner = m >> 1, m & 1 == 0
        bits = group.column("bits").to_pylist()
        two = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        if root.min() == root.max():
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        width = np.asarray([len(b) for b in bits])
        part = {int(w): (np.flatnonzero(width == w), np.stack([np.frombuffer(b, np.uint64) for b in bits if len(b) == w])) for w in np.unique(width)}
        low = np.searchsorted(100 * n, percent * n, "left")  # n ascends with m
        a, b = [], []
        for y in range(len(node)):
            mine = _folded(np.frombuffer(bits[y], np.uint8), len(bits[y]))
            for w, (at, rest) in part.items():
                if w > len(mine):
                    continue
                s, e = np.searchsorted(at, (low[y], y))
                xs = at[s:e]
                far = inner[xs] & (root[xs] != root[y])
                if two:
                    far &= own[xs] != own[y]
                if not far.any():
                    continue
                xs, some, own_bits = xs[far], rest[s:e][far], _folded(mine, w).view(np.uint64)
                gone = np.bitwise_count(some & ~own_bits).sum(1)
                lack = np.bitwise_count(own_bits & ~some).sum(1)
                bound = np.minimum(n[xs] - gone, n[y] - lack)
                near = node[xs[(100 + percent) * bound >= percent * (n[xs] + n[y])]]
                a.append(np.minimum(near, node[y]))
                b.append(np.maximum(near, node[y]))
        none = [np.zeros(0, np.int64)]
        return pa.table({"a": pa.array(np.concatenate(a or none)), "b": pa.array(np.concatenate(b or none))})

    return rows.groupBy("token", "i", "j").applyInArrow(meet, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``: the size of its set of distinct
    ``words``-word shingles, and the smallest id that it reaches by links, where two rows link if
    100 * intersection >= percent * union.

    Words are split at ASCII white space, A-Z lower-cased.  A text with fewer words is one shingle; a null
    text or one without words is empty, links with nothing and has its own id as component.  A row with a
    null id is linked like any other, but counts in no smallest id (null if the component has no id).
    Rows that share an id are rows of their own.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("t"), F.col(text_col).alias("text"))
    held = Scratch()
    every = held.write(_signatures(rows, words, percent), "signatures")
    one = every.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "t", "n", "few", "few_in", "many", "many_in", "bits")).alias("m"))
    sets = held.write(one.select(F.monotonically_increasing_id().alias("s"), "node", "m.*"), "sets")
    where = lambda pairs: held.write(sets.join(pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct(), "s").select("s", F.col("doc_id").alias("d"), F.col("t").alias("h")), "places")

    tiles = held.write(_tiles(sets, percent), "tiles")
    central = sets.select("s", (F.size("many") / (F.size("many") + F.size("few"))).alias("c"))
    large = tiles.where("token IS NOT NULL").select("token", F.col("a").alias("s"), "m").unionByName(_prefix(sets, "many"))
    large = held.write(large.join(central, "s").withColumn("n", F.shiftright("m", 1)), "large-tiles")
    centres = large.groupBy("token").agg(F.max(F.struct("c", "s", "n")).alias("x"))
    stars = large.join(centres, "token").where(f"s <> x.s AND 100 * least(n, x.n) >= {percent} * greatest(n, x.n)").select(F.least("x.s", "s").alias("a"), F.greatest("x.s", "s").alias("b"))
    pairs = tiles.where("token IS NULL").select("a", "b").unionByName(stars).distinct()
    close = held.write(_bounded(pairs, sets, percent), "close")
    held.drop(tiles)

    # rounds: each set with its most central partner that it is not connected with, then whatever is left
    tested = held.write(_central_pairs(close, central), "tested")
    places = where(tested)
    links = held.write(_linked(tested, places, rows, words, percent), "links")
    roots = components(links, held)
    across = _across(large, roots, sets, percent)
    left = held.write(_apart(close, roots).join(tested, ["a", "b"], "left_anti").unionByName(across).distinct(), "apart")
    held.drop(places, tested, close, large)
    second = held.write(_central_pairs(left, central), "tested")
    places = where(left)
    more = held.write(_linked(second, places, rows, words, percent), "links")
    stars, before = lambda r: r.select(F.col("node").alias("a"), F.col("root").alias("b")), roots
    roots = components(stars(before).unionByName(more), held)
    third = _apart(left.join(second, ["a", "b"], "left_anti"), roots)
    rest = held.write(_linked(third, places, rows, words, percent), "links")
    final = components(stars(roots).unionByName(rest), held)
    classes = held.write(sets.select("s", "node").join(final.withColumnRenamed("node", "s"), "s", "left").select("node", F.coalesce("root", "s").alias("root")), "classes")
    held.drop(links, more, rest, before, roots, final, places, second, left, sets)

    placed = every.select("doc_id", F.col("n").alias("n_shingles"), "node").join(classes, "node", "left").select("doc_id", "n_shingles", "root")
    smallest = placed.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    return placed.join(smallest, "root", "left").select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the same columns and the rows of one id of each component, the smallest.  Rows with
    empty texts or null ids stay.  An id with several texts goes if one of its rows is not the smallest."""
    own = free_name(docs.columns, "__gone")
    gone = jaccard_components(docs, words, percent, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(own), "left_anti")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of all documents, at four words and 85 percent."""
    return jaccard_components(table(spark, sf_dir, "documents"))


#: The same by plain means: shingles themselves, all pairs that share one, and all that each document reaches.
OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n FROM (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents)),
g AS (SELECT doc_id, n, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS l, i FROM w),
s AS (SELECT DISTINCT doc_id, array_to_string(l, ' ') AS k FROM g WHERE len(l) = least(n, 4) AND (n >= 4 OR i = 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN c a ON a.doc_id = x JOIN c b ON b.doc_id = y WHERE 100 * p.n >= 85 * (a.n + b.n - p.n)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, z.y FROM r JOIN (SELECT x, y FROM e UNION SELECT y, x FROM e) z ON z.x = r.y)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, q.least AS component_id FROM documents d LEFT JOIN c USING (doc_id) JOIN (SELECT x, min(y) AS least FROM r GROUP BY x) q ON q.x = d.doc_id
"""
