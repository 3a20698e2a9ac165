"""Merkle manifest of a dataset: a tree for each group of rows (a source), and one over the groups' roots.

Rows are hashed where they are read; from then on only digests move.  Their places in the group come
from one range sort and prefix sums over its partitions.  Trees grow by combining: each task merges what it
has under the parent's key, a parent whose arity (which follows from the number of leaves) is met
becomes a child of its own parent at once, and partial parents are shuffled to fewer tasks, till none is left.  Finished
runs keep their children: followed from the root down, they are the reverse links that proofs are made of.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

ARITY_BITS = 4
_ARITY = 1 << ARITY_BITS
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(*fields: Column) -> Column:
    """Hex SHA-256 of the fields as text, each as its UTF-8 length, a colon and its bytes; null: ``-``."""
    parts = [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*parts), 256)


def indexed(rows: DataFrame, group: list[str], order: list[str], held: Scratch) -> DataFrame:
    """``rows`` with ``idx``, the place in the group in the order given (nulls first), and ``total``, the
    group's rows.  A range sort by group and order splits any group over tasks; the places are those in
    the partition plus the rows of the group before it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    placed = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = held.write(placed.withColumns({"at": F.spark_partition_id(), "seq": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "placed")
    counts = placed.groupBy("at", *group).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    bases = counts.select(
        F.col("at").alias("at_"), *[F.col(c).alias(f"{c}_") for c in group], (F.sum("n").over(whole.orderBy("at")) - F.col("n") - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("total")
    )
    on = placed["at"] == bases["at_"]
    for c in group:
        on = on & placed[c].eqNullSafe(bases[f"{c}_"])
    return placed.join(bases, on).withColumn("idx", F.col("seq") + F.col("shift")).drop("at_", "seq", "shift", *[f"{c}_" for c in group])


def _climb(batches):
    """Nodes (g, level, idx, total, digest) to finished runs (with children) and nodes whose run is still open."""
    import pandas as pd

    partial: dict[tuple, dict[int, str]] = {}
    sizes: dict[int, list[int]] = {}

    def widths(total: int) -> list[int]:
        if total not in sizes:
            row = [total]
            while row[-1] > 1:
                row.append((row[-1] + _ARITY - 1) >> ARITY_BITS)
            sizes[total] = row
        return sizes[total]

    columns = ["g", "level", "idx", "total", "digest", "children", "top"]
    for batch in batches:
        out = []
        for g, level, idx, total, digest in zip(*(batch[c].tolist() for c in columns[:5]), strict=True):
            row = widths(total)
            while level + 1 < len(row):
                parent = idx >> ARITY_BITS
                run = partial.setdefault((g, level + 1, parent, total), {})
                run[idx & (_ARITY - 1)] = digest
                arity = min(_ARITY, row[level] - (parent << ARITY_BITS))
                if len(run) < arity:
                    break
                del partial[g, level + 1, parent, total]
                children = "".join(run[i] for i in range(arity))
                level, idx, digest = level + 1, parent, sha256(children.encode()).hexdigest()
                out.append((g, level, idx, total, digest, children, level + 1 == len(row)))
        yield pd.DataFrame(out, columns=columns)
    left = [(g, level - 1, (parent << ARITY_BITS) | i, total, digest, None, False) for (g, level, parent, total), run in partial.items() for i, digest in run.items()]
    for k in range(0, len(left), 10_000):
        yield pd.DataFrame(left[k : k + 10_000], columns=columns)


def grow(leaves: DataFrame, held: Scratch) -> tuple[DataFrame, DataFrame]:
    """(runs, roots) of the trees over ``leaves`` (g, idx, total, digest): ``runs`` has g, level, idx, digest,
    children (their digests, joined) and top; ``roots`` has g and digest."""
    schema = "g long, level int, idx long, total long, digest string, children string, top boolean"
    nodes = leaves.select("g", F.lit(0).alias("level"), "idx", "total", "digest")
    parts, runs = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")), None
    while True:
        out = held.write(nodes.mapInPandas(_climb, schema), "nodes")
        done = out.where("children is not null")
        runs = done if runs is None else runs.unionByName(done)
        frontier = out.where("children is null")
        if frontier.isEmpty():
            break
        if parts == 0:
            raise ValueError("nodes are missing below an open run")
        # a task leaves at most two open runs of each level behind, so few tasks are enough for the rest
        parts >>= 6
        nodes = frontier.repartitionByRange(parts, "g", F.expr(f"shiftleft(idx, {ARITY_BITS} * level)")) if parts > 1 else frontier.coalesce(1)
        parts = parts if parts > 1 else 0
    roots = leaves.where("total = 1").select("g", "digest").unionByName(runs.where("top").select("g", "digest"))
    return runs, roots


def _beside(children: str, place: str) -> Column:
    """What stands left and right of the child at ``place`` in a run."""
    return F.expr(f"named_struct('left', substring({children}, 1, 64 * cast({place} as int)), 'right', substring({children}, 64 * cast({place} as int) + 65))")


_PATH = "array<struct<left:string,right:string>>"


def proofs(leaves: DataFrame, runs: DataFrame, roots: DataFrame) -> DataFrame:
    """``leaves`` with ``path``, the (left, right) siblings of each level from the leaf to the root, and
    ``subroot``.  ``roots``: g, subroot and the path from there on."""
    tall = runs.agg(F.max("level")).first()[0] or 0
    above = None
    for level in range(tall, 0, -1):
        here = runs.where(F.col("level") == level)
        paths = here.where("top").join(roots, "g").select("g", "idx", "children", "subroot", "path")
        if above is not None:
            up = above.select("g", F.col("idx").alias("parent"), F.col("children").alias("run"), "subroot", F.col("path").alias("rest"))
            low = here.where("not top").withColumn("parent", F.shiftright("idx", ARITY_BITS)).join(up, ["g", "parent"])
            paths = paths.unionByName(low.select("g", "idx", "children", "subroot", F.concat(F.array(_beside("run", f"(idx & {_ARITY - 1})")), "rest").alias("path")))
        above = paths
    names = leaves.columns
    lone = leaves.where("total = 1").join(roots, "g").select(*names, "subroot", "path")
    if above is None:
        return lone
    up = above.select("g", F.col("idx").alias("parent"), F.col("children").alias("run"), "subroot", F.col("path").alias("rest"))
    many = leaves.where("total > 1").withColumn("parent", F.shiftright("idx", ARITY_BITS)).join(up, ["g", "parent"])
    return lone.unionByName(many.select(*names, "subroot", F.concat(F.array(_beside("run", f"(idx & {_ARITY - 1})")), "rest").alias("path")))


def proof_digest(path: str = "path") -> Column:
    """Hex SHA-256 of all siblings of a path, from the leaf up and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(own: Column, path: str = "path") -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, own, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256))


def manifest(docs: DataFrame, group_col: str = "source", id_col: str = "doc_id", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), others: dict[str, Column] | None = None) -> DataFrame:
    """Each row of ``docs`` as ``doc_id, source`` (the id and group columns), ``leaf, subroot, root, path``
    and ``others``, further digests taken of the row at the same reading.

    Groups are in the order of their names (null first, by UTF-8 bytes), rows in that of their ids (null
    first, rows of one id by their leaf); equal rows are leaves each.  Only the named columns are read.
    Null fields hash as ``-``; no rows: no result.  A group of any size is spread over all tasks.
    """
    held, others = Scratch(), others or {}
    leaves = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{group_col}`").alias("source"), leaf_digest(*[F.col(f"`{f}`") for f in fields]).alias("leaf"), *[c.alias(name) for name, c in others.items()])
    read = held.write(leaves, "leaves")
    leaves = held.write(indexed(read, ["source"], ["doc_id", "leaf"], held), "indexed")
    held.drop(read)
    groups = indexed(leaves.where("idx = 0").select("source"), [], ["source"], held).select(F.col("source").alias("name"), F.col("idx").alias("g"), F.col("total").alias("groups"))
    groups = held.write(groups, "groups")
    # a group is as many keys as it has partitions, so that a large one doesn't meet its number in one task
    places = leaves.select("at", "source").distinct().join(groups, F.col("source").eqNullSafe(F.col("name"))).select(F.col("at").alias("part"), "name", "g")
    numbered = held.write(leaves.join(places, (leaves["at"] == places["part"]) & leaves["source"].eqNullSafe(places["name"])).drop("part", "name", "at"), "numbered")
    runs, subroots = grow(numbered.withColumnRenamed("leaf", "digest"), held)
    subroots = held.write(subroots, "subroots")
    tops = groups.join(subroots, "g").select(F.lit(0).cast("long").alias("g"), F.col("g").alias("idx"), F.col("groups").alias("total"), "digest")
    tops = held.write(tops, "tops")
    top_runs, top = grow(tops, held)
    root = top.first()
    base = top.select("g", F.col("digest").alias("subroot"), F.array().cast(_PATH).alias("path"))
    paths = proofs(tops, top_runs, base).select(F.col("idx").alias("g"), F.col("digest").alias("subroot"), "path")
    paths = held.write(paths, "paths")
    return proofs(numbered, runs, paths).select("doc_id", "source", "leaf", *others, "subroot", F.lit(root["digest"] if root else None).cast("string").alias("root"), "path")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of all documents, one row each.

    ``folded_root`` is recomputed from the siblings and the leaf, which for one id in five is that of the text in
    lower case; a null id is not tampered with, nor is a null text."""
    docs = table(spark, sf_dir, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    low = leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.translate("text", _UPPER, _LOWER))
    rows = manifest(docs, others={"tampered": F.when(chosen, low)})
    rows = rows.withColumns({"proof_sha256": proof_digest(), "folded_root": folded(F.coalesce("tampered", "leaf"))})
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256({})".format(" || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")))
#: The same by plain means: each level from the one below it, and each leaf's way up.  CRC-32 is bit by bit.
OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_LEAF.format(text="text")} AS leaf, {_LEAF.format(text=f"translate(text, '{_UPPER}', '{_LOWER}')")} AS low,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda x, i: xor(x // 2, 3988292384 * (x % 2)))), 4294967295) AS crc
  FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (ORDER BY doc_id, leaf) AS row FROM d),
t AS (
  SELECT source, 0 AS level, idx, n, leaf AS h FROM l
  UNION ALL SELECT source, level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY source, level, idx // 16, n),
s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, idx, n, subroot AS h FROM s
  UNION ALL SELECT level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY level, idx // 16, n),
runs AS (
  SELECT source, level, idx // 16 AS p, list(h ORDER BY idx) AS h FROM t WHERE n > 1 GROUP BY source, level, idx // 16
  UNION ALL SELECT s.source, u.level + 100, u.idx // 16, list(u.h ORDER BY u.idx) FROM u, s WHERE u.n > 1 AND u.idx // 16 = s.idx // CAST(power(16, u.level + 1) AS BIGINT) GROUP BY s.source, u.level, u.idx // 16),
steps AS (
  SELECT row, r.level, CASE WHEN r.level < 100 THEN l.idx // CAST(power(16, r.level) AS BIGINT) ELSE s.idx // CAST(power(16, r.level - 100) AS BIGINT) END % 16 AS place, r.h
  FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN runs r ON r.source IS NOT DISTINCT FROM l.source AND (r.level >= 100 OR r.p = l.idx // CAST(power(16, r.level + 1) AS BIGINT))),
p AS (
  SELECT row, string_agg(array_to_string(h[1:place], '') || array_to_string(h[place + 2:], ''), '' ORDER BY level) AS proof,
    list(array_to_string(h[1:place], '') ORDER BY level) AS a, list(array_to_string(h[place + 2:], '') ORDER BY level) AS b FROM steps GROUP BY row),
f AS (
  SELECT row, 1 AS k, CASE WHEN crc % 5 = 0 THEN low ELSE leaf END AS h FROM l
  UNION ALL SELECT f.row, k + 1, sha256(a[k] || h || b[k]) FROM f JOIN p ON f.row = p.row WHERE k <= len(a))
SELECT l.doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, e.h AS folded_root, e.h = root AS verified
FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source LEFT JOIN p ON p.row = l.row JOIN (SELECT row, arg_max(h, k) AS h FROM f GROUP BY row) e ON e.row = l.row, (SELECT h AS root FROM u WHERE n = 1)
"""
