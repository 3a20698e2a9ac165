"""Sharding by fixed virtual slots.

A record's hash gives its slot, one of thousands; the bytes and rows of each slot are summed where
the records are; and a small map, kept in numbered versions, gives each slot its shard.  Shards get
near equal bytes.  When data or the number of shards change, the map is edited: only the slots that
have to move do so, and records move with their slot.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Files, Scratch, free_name, new_path, table

#: Slots: the map has one entry for each, whatever the number of records.
SLOTS = 8192
#: A slot with more than this part of a shard's fair share of bytes is dealt anew, row by row.
HOT = 4


def levelled(shard_of: list[int], sizes: list[int], shards: int, into: int = 0) -> list[int]:
    """The map edited so that shards 0 to ``shards`` - 1 have near equal sizes: the largest fitting slot goes from the
    fullest shard to the emptiest of those from ``into`` on, as long as that brings the two nearer.  Slots of
    dropped shards go first."""
    from bisect import bisect_left, bisect_right, insort

    out, own, load = list(shard_of), [[] for _ in range(shards)], [0] * shards
    for slot, shard in enumerate(out):
        if shard < shards:
            own[shard].append((sizes[slot], slot))
            load[shard] += sizes[slot]
    heap = [(n, k) for k, n in enumerate(load)]
    heapq.heapify(heap)
    for size, slot in sorted(((sizes[s], s) for s, shard in enumerate(out) if shard >= shards), key=lambda x: (-x[0], x[1])):
        n, k = heapq.heappop(heap)
        out[slot] = k
        own[k].append((size, slot))
        heapq.heappush(heap, (n + size, k))
    for n, k in heap:
        load[k] = n
    for have in own:
        have.sort()
    while True:
        full, empty = max(range(shards), key=lambda k: (load[k], -k)), min(range(into, shards), key=lambda k: (load[k], k))
        gap, have = load[full] - load[empty], own[full]
        at = bisect_right(have, (gap // 2, len(sizes))) - 1
        if at < 0 or have[at][0] == 0:  # none of half the gap: the smallest one, if it is less than the gap
            at = bisect_left(have, (1, -1))
            if at == len(have) or have[at][0] >= gap:
                return out
        size, slot = have.pop(at)
        insort(own[empty], (size, slot))
        out[slot] = empty
        load[full] -= size
        load[empty] += size


class SlotMap:
    """Versions of a slot-to-shard map, each a file of its own in one folder; a version is never changed."""

    def __init__(self, path: str):
        self.files = Files(path)

    def write(self, version: int, shard_of: list[int], shards: int) -> None:
        self.files.write(f"v{version:06d}.json", [json.dumps({"version": version, "shards": shards, "slots": shard_of}).encode()])

    def read(self, version: int) -> dict:
        with self.files.open(f"v{version:06d}.json") as f:
            return json.loads(f.read())

    def first(self, sizes: list[int], shards: int) -> list[int]:
        """Version 1: the largest slots first, each to the shard that has least; empty slots go around."""
        shard_of = levelled([shards if n else slot % shards for slot, n in enumerate(sizes)], sizes, shards)
        self.write(1, shard_of, shards)
        return shard_of

    def edit(self, version: int, sizes: list[int], shards: int) -> list[int]:
        """The version after ``version``, for the sizes and the number of shards as they are now.  New shards take
        slots and nothing else moves; with as many shards as before, or fewer, slots move between any."""
        before = self.read(version)
        shard_of = levelled(before["slots"], sizes, shards, before["shards"] if shards > before["shards"] else 0)
        self.write(version + 1, shard_of, shards)
        return shard_of


def slotted(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes of the text, null: none, and one), ``text_crc32`` and ``virtual_slot``."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    named = {"size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text.cast("binary"))}
    rows = docs.withColumns({k: v for k, v in named.items()})
    record = F.concat_ws("|", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")), "size", "text_crc32")
    return rows.withColumn("virtual_slot", F.crc32(record.cast("binary")) % slots)


def slot_sizes(rows: DataFrame, slots: int) -> tuple[list[int], list[int]]:
    """(bytes, rows) of each slot."""
    sizes, counts = [0] * slots, [0] * slots
    for slot, size, n in rows.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect():  # at most one row for each slot
        sizes[slot], counts[slot] = size, n
    return sizes, counts


def sharded(docs: DataFrame, shards: int = 16, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot, shard, slot, next_shard`` of each row: ``slot`` is the place in the
    shard, from 0 without gaps; ``next_shard`` is the shard after one more has been added.

    The map is versions 1 and 2 below ``map_path``.  Null texts have no bytes; null ids are hashed as such.
    Repeated rows are records each.  Equal rows have equal hashes: where they
    make one slot hold more than a fourth of a shard's fair share, that slot's rows are dealt to slots by their places in the
    input, so that not even a third of all rows in one key fills a shard.  One text of more than a fair share fills a shard
    by itself.  No rows: no result.  Other columns are not read.
    """
    spark, held = docs.sparkSession, Scratch()
    rows = slotted(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), slots, "doc_id", "text").drop("text")
    rows = held.write(rows.withColumn("at", F.monotonically_increasing_id()), "records")
    sizes, counts = slot_sizes(rows, slots)
    hot = [slot for slot, size in enumerate(sizes) if size * HOT * shards > sum(sizes) and counts[slot] > 1]
    if hot:
        rows = rows.withColumn("virtual_slot", F.when(F.col("virtual_slot").isin(hot), F.crc32(F.col("at").cast("string").cast("binary")) % slots).otherwise(F.col("virtual_slot")))
        sizes, counts = slot_sizes(rows, slots)
    versions = SlotMap(map_path or new_path(spark, "slot_map"))
    now = versions.first(sizes, shards)
    after = versions.edit(1, sizes, shards + 1)
    bases, have = [], [0] * shards
    for slot in range(slots):
        bases.append(have[now[slot]])
        have[now[slot]] += counts[slot]
    places = spark.createDataFrame([(slot, now[slot], bases[slot], after[slot]) for slot in range(slots)], "virtual_slot long, shard int, base long, next_shard int")
    order = Window.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32", "at")
    # the map has one row for each slot, whatever the size of the data
    out = rows.withColumn("place", F.row_number().over(order)).join(F.broadcast(places), "virtual_slot")
    return out.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("base") + F.col("place") - 1).alias("slot"), "next_shard")


def write_shards(docs: DataFrame, shard_of: dict | list[int], path: str, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` as Parquet below ``path``, a folder for each shard of a version of the map
    (its ``slots``); read back with the folder's number as ``shard``."""
    spark, names = docs.sparkSession, docs.columns
    slot, shard = free_name(names, "virtual_slot"), free_name(names, "shard")
    keyed = slotted(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")), slots)
    places = spark.createDataFrame(list(enumerate(shard_of)), f"virtual_slot long, `{shard}` int")
    rows = keyed.join(F.broadcast(places), "virtual_slot").withColumn(slot, F.col("virtual_slot")).repartition(shard, slot).select("row.*", shard)
    rows.write.partitionBy(shard).parquet(path)
    return spark.read.parquet(path)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of all documents in 16 shards of near equal bytes;
    with that law ``grown_shard`` is null.  Besides: the virtual slot, and the shard after one more is added."""
    out = sharded(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "next_shard")
