"""Removal of repeated byte strings by distributed prefix doubling.

A position's rank for a length is a 64-bit name: that of length 2L is made of the names of length L at the
position and L further on, for offsets 1, 2, 4, ... 32.  A string of the threshold length is the pair of its
64-byte names at its start and at its end, which overlap: pairs are equal just where the strings are.  Names
need no order between positions, so ranks of short lengths are made where a text is, and Spark sorts only
(rank, rank at an offset) pairs, in two steps that drop what is unique before the next offset:

1. Of the strings that start at successive positions, those with the same least 32-byte name in them (their
   anchor, at the same place of equal strings) form one unit of text.  Spark sorts units by the anchor's
   rank, then by the rank pairs of the unit's first and last string.  A unit equal to an earlier one is
   repeated throughout; one whose anchor stands in no other text is unique throughout.  What is left open
   are first units that share an anchor with different ones: the ends of repeated passages.
2. The strings of open units alone are sorted by their rank pairs, and all but the first of equals are
   repeated.  Units go there as they are, by their anchor, and are cut into strings where they arrive.

Repeated strings within a batch are settled there (the first one alone goes on), and anchors that are
frequent in a batch are spread over salted groups that are open by definition, whose strings go to the
second step one by one, by their own rank; so no group that is sorted grows with the copies of one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: Strings are worked on in blocks of so many positions; a place in a block takes PLACE_BITS bits.
BLOCK, PLACE_BITS = 1 << 20, 22
ANCHOR, HALF = 24, 64
#: An anchor with so many different units in one batch counts as frequent there.
FREQUENT, SALTS = 64, 64
LOSER, OPEN, HOT = 0, 1, 2
_NORMAL, _SALTED, _MARK, _SETTLED = 0, 1, 2, 3


def _mix(a, b):
    import numpy as np

    x = a * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x += b
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


class Block:
    """Names and units of the strings of ``length`` bytes in one buffer of separate pieces."""

    def __init__(self, data, pieces, length: int):
        import numpy as np

        n = len(data)
        names = _mix(np.arange(1, 257, dtype=np.uint64) << np.uint64(40), np.arange(256, dtype=np.uint64))[data]
        offset, anchors = 1, None
        while offset < HALF:
            shorter, names = names, _mix(names[:-offset], names[offset:])
            offset *= 2
            if offset == 16:  # 24 bytes: 16, and 8 from the 16th on
                anchors = _mix(names[: len(names) - 8], shorter[16:])
        self.names, self.last = names, length - HALF
        valid = np.zeros(n - length + 1, bool)
        for start, size in pieces:
            if size >= length:
                valid[start : start + size - length + 1] = True
        mask = np.uint64((1 << PLACE_BITS) - 1)
        least = (anchors & ~mask) | np.arange(len(anchors), dtype=np.uint64)
        width, done = length - ANCHOR + 1, 1
        while done * 2 <= width:
            least = np.minimum(least[:-done], least[done:])
            done *= 2
        if width > done:
            least = np.minimum(least[: done - width], least[width - done :])
        at = np.flatnonzero(valid)
        place = (least[at] & mask).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        self.start = at[first]
        self.size = np.diff(np.append(first, len(at)))
        self.anchor = anchors[place[first]]

    def pair(self, at):
        """The rank pair of the strings at the given places."""
        return self.names[at], self.names[at + self.last]

    def unit_rank(self):
        """One name for the rank pairs of a unit's first and last string and its size; units are equal
        where this and the anchor's name are."""
        import numpy as np

        end = self.start + self.size - 1
        return _mix(_mix(*self.pair(self.start)), _mix(*self.pair(end)) + self.size.astype(np.uint64))


def _blocks(rows, length: int):
    """(rows of the pieces, offsets of the pieces in their texts, piece starts, Block) over texts as bytes.
    A piece starts at a multiple of BLOCK in its text, whatever other texts are there."""
    import numpy as np

    held, size = [], 0

    def close():
        starts = np.cumsum([0, *(len(x[2]) for x in held)])
        data = np.frombuffer(b"".join([x[2] for x in held]), np.uint8)
        pieces = list(zip(starts[:-1].tolist(), [len(x[2]) for x in held], strict=True))
        return np.asarray([x[0] for x in held]), np.asarray([x[1] for x in held]), starts[:-1], Block(data, pieces, length)

    for k, text in enumerate(rows):
        for at in range(0, len(text) - length + 1, BLOCK):
            held.append((k, at, text[at : at + BLOCK + length - 1]))
            size += len(held[-1][2])
            if size >= BLOCK:
                yield close()
                held, size = [], 0
    if held:
        yield close()


def _settle(g, k, d, p):
    """Of rows with equal (g, k) in one batch only the first goes on; the rest are settled, under keys
    that spread them.  The rows keep their order, which compresses better than any other."""
    import numpy as np

    order = np.lexsort((p, d, k, g))
    new = np.ones(len(g), bool)
    new[1:] = (g[order][1:] != g[order][:-1]) | (k[order][1:] != k[order][:-1])
    first = np.empty(len(g), bool)
    first[order] = new
    return np.where(first, g, _mix(p.astype(np.uint64), d.view(np.uint64))), np.where(first, _NORMAL, _SETTLED)


def _pack(p, n, kind):
    """Place, number of strings and kind in one long."""
    return (p << 9) | (n << 2) | kind


def _batch(g, k, d, x, unit=None):
    import numpy as np
    import pyarrow as pa

    columns = [pa.array(g.view(np.int64)), pa.array(k.view(np.int64)), pa.array(d), pa.array(x)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(unit, pa.binary())] if unit is not None else columns, ["g", "k", "d", "x", "unit"][: 5 if unit is not None else 4])


_ROWS = "g long, k long, d long, x long"


def _texts(batch, column: int):
    from zstandard import ZstdDecompressor

    return map(ZstdDecompressor().decompress, batch.column(column).to_pylist())


def _units(docs: DataFrame, length: int) -> DataFrame:
    import numpy as np

    def scan(batches):
        for batch in batches:
            ids, bases = (batch.column(i).to_numpy() for i in (0, 1))
            parts = []
            for r, at, starts, block in _blocks(batch.column(2).to_pylist(), length):
                piece = np.searchsorted(starts, block.start, "right") - 1
                parts.append((block.anchor, block.unit_rank(), ids[r[piece]], bases[r[piece]] + at[piece] + block.start - starts[piece], block.size))
            if not parts:
                continue
            g, k, d, p, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            spread, kind = _settle(g, k, d, p)
            found, where, count = np.unique(np.where(kind == _NORMAL, g, 0), return_inverse=True, return_counts=True)
            often = (count >= FREQUENT) & (found != 0)
            salted = often[where] & (kind == _NORMAL)
            kind = np.where(salted, _SALTED, kind)
            yield _batch(np.where(salted, _mix(g, k % np.uint64(SALTS)), spread), k, d, _pack(p, n, kind))
            if often.any():
                zero = np.zeros(int(often.sum()), np.int64)
                yield _batch(found[often], zero.view(np.uint64), zero, zero + _MARK)

    return docs.mapInArrow(scan, _ROWS)


def _open(docs: DataFrame, length: int) -> DataFrame:
    """The open units of ``docs`` (d, base, packed text, places, places of frequent anchors): a row each
    with its bytes, by its anchor; those of frequent anchors as a row for each string, by its name."""
    import numpy as np

    def scan(batches):
        for batch in batches:
            ids, bases = (batch.column(i).to_numpy() for i in (0, 1))
            wanted, hot = (batch.column(i).to_pylist() for i in (3, 4))
            texts = list(_texts(batch, 2))
            strings = []
            for r, at, starts, block in _blocks(texts, length):
                piece = np.searchsorted(starts, block.start, "right") - 1
                p = bases[r[piece]] + at[piece] + block.start - starts[piece]
                bounds = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1], [True]])) if len(p) else np.zeros(1, np.int64)
                runs = list(zip(bounds[:-1], bounds[1:], strict=True))
                take = np.concatenate([np.isin(p[a:b], wanted[r[piece[a]]]) for a, b in runs]) if runs else np.zeros(0, bool)
                if take.any():
                    rows, places, sizes = r[piece[take]], p[take], block.size[take]
                    units = [texts[i][q - bases[i] : q - bases[i] + n + length - 1] for i, q, n in zip(rows, places, sizes, strict=True)]
                    yield _batch(block.anchor[take], np.zeros(len(rows), np.int64), ids[rows], _pack(places, sizes, _NORMAL), units)
                take = np.concatenate([np.isin(p[a:b], hot[r[piece[a]]]) for a, b in runs]) if runs else np.zeros(0, bool)
                if take.any():
                    start, size = block.start[take], block.size[take]
                    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    g, k = block.pair(np.repeat(start, size) + inside)
                    strings.append((g, k, np.repeat(ids[r[piece[take]]], size), np.repeat(p[take], size) + inside))
            if strings:
                g, k, d, p = (np.concatenate(x) for x in zip(*strings, strict=True))
                spread, kind = _settle(g, k, d, p)
                yield _batch(spread, k, d, _pack(p, 1, kind), [None] * len(g))

    return docs.mapInArrow(scan, f"{_ROWS}, unit binary")


def _sorted_groups(rows: DataFrame, decide, schema: str) -> DataFrame:
    """``decide`` over runs of whole groups, from rows sorted by group, rank and place."""
    import pyarrow as pa

    def run(batches):
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0] if batch.num_rows else held
            if not batch.num_rows:
                continue
            g = batch.column(0).to_numpy()
            cut = int(g.searchsorted(g[-1]))
            if cut:
                yield decide(batch.slice(0, cut))
            held = batch.slice(cut)
        if held is not None:
            yield decide(held)

    return rows.repartition("g").sortWithinPartitions("g", "k", "d", "x").mapInArrow(run, schema)


def _losers(g, k, x):
    """Of sorted rows those that were settled or are not the first of their (g, k)."""
    import numpy as np

    again = np.zeros(len(g), bool)
    again[1:] = (g[1:] == g[:-1]) & (k[1:] == k[:-1])
    return again | ((x & 3) == _SETTLED)


def _judged(rows: DataFrame) -> DataFrame:
    """(d, p, n, state): units that are not the first of equals, and firsts that share their anchor with
    different ones."""
    import numpy as np
    import pyarrow as pa

    def decide(batch):
        g, k, d, x = (c.to_numpy() for c in batch.columns)
        kind = x & 3
        lose = _losers(g, k, x)
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        group = np.cumsum(new) - 1
        hot = np.bincount(group, (kind == _MARK) | (kind == _SALTED)) > 0
        different = hot | (np.bincount(group, ~lose) > 1)
        keep = (lose | different[group]) & (kind != _MARK)
        state = np.where(lose, LOSER, np.where(hot[group], HOT, OPEN)).astype(np.int8)
        return pa.RecordBatch.from_arrays([pa.array(d[keep]), pa.array(x[keep] >> 9), pa.array(((x[keep] >> 2) & 127).astype(np.int32)), pa.array(state[keep])], ["d", "p", "n", "state"])

    return _sorted_groups(rows, decide, "d long, p long, n int, state byte")


def _slices(units: list[bytes]):
    held, size = [], 0
    for u in units:
        held.append(u)
        size += len(u)
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _judged_strings(rows: DataFrame, length: int) -> DataFrame:
    """(d, p, n): runs of strings that are not the first of their equals."""
    import numpy as np
    import pyarrow as pa

    def decide(batch):
        g, k, d, x = (batch.column(i).to_numpy() for i in range(4))
        alone = batch.column(4).is_null().to_numpy(zero_copy_only=False)
        lose = _losers(g, k, x) & alone
        out_d, out_p, out_n = [d[lose]], [x[lose] >> 9], [np.ones(int(lose.sum()), np.int32)]
        units = batch.column(4).filter(pa.array(~alone)).to_pylist()
        if units:
            d, x = d[~alone], x[~alone]
            n = np.asarray([len(u) for u in units]) - length + 1
            pairs = []
            for some in _slices(units):  # names take many times the bytes they are made of
                begin = np.cumsum([0, *(len(u) for u in some)])
                block = Block(np.frombuffer(b"".join(some), np.uint8), list(zip(begin[:-1].tolist(), np.diff(begin).tolist(), strict=True)), length)
                size = np.diff(begin) - length + 1
                pairs.append(block.pair(np.repeat(begin[:-1], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)))
            a, b = (np.concatenate(v) for v in zip(*pairs, strict=True))
            row = np.repeat(np.arange(len(units), dtype=np.int32), n)
            p = (x >> 9)[row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            order = np.lexsort((p, d[row], b, a))
            again = np.zeros(len(row), bool)
            again[1:] = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
            lost = np.zeros(len(row), bool)
            lost[order] = again
            # successive lost strings of one unit as one run
            first = lost.copy()
            first[1:] &= ~lost[:-1] | (row[1:] != row[:-1])
            at = np.flatnonzero(first)
            if len(at):
                out_d.append(d[row[at]])
                out_p.append(p[at])
                out_n.append(np.add.reduceat(lost.astype(np.int32), at))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_d)), pa.array(np.concatenate(out_p)), pa.array(np.concatenate(out_n).astype(np.int32))], ["d", "p", "n"])

    return _sorted_groups(rows, decide, "d long, p long, n int")


def _packed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``data`` compressed: what two joins move."""
    import pyarrow as pa

    names = rows.columns
    at = names.index("data")

    def run(batches):
        from zstandard import ZstdCompressor

        pack = ZstdCompressor(level=3).compress
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([pack(x) for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, rows.schema)


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """(d, p, n): n successive strings from p on that start earlier, for rows (d, base, data) of docs; p is
    an offset in the row's bytes plus its base.  Runs of one row may touch."""
    units = materialise(_judged(_units(docs, length)), "units")
    places = lambda state: F.collect_list(F.when(F.col("state") == state, F.col("p")))
    wanted = units.where(f"state <> {LOSER}").groupBy("d").agg(places(OPEN).alias("wanted"), places(HOT).alias("hot"))
    strings = _judged_strings(_open(_packed(docs).join(wanted, "d"), length), length)
    return units.where(f"state = {LOSER}").select("d", "p", "n").unionByName(strings)


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, d, base, data): rows that share an id follow each other by the hash of their text."""
    d = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), d.alias("d"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("data"))
    twice = rows.groupBy("d").agg(F.count("*").alias("c")).where("c > 1").select("d")
    if twice.isEmpty():
        return rows.select("doc_id", "d", F.lit(0).cast("long").alias("base"), "data")
    from pyspark.sql import Window

    before = Window.partitionBy("d").orderBy(F.xxhash64("data")).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("doc_id", "d", F.coalesce(F.sum(F.octet_length("data").cast("long")).over(before), F.lit(0).cast("long")).alias("base"), "data")


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept``: for each row of ``docs`` the bytes of its text that
    are left when every byte goes that a string of ``length`` bytes covers which also starts earlier
    (smaller id, or the same text and an earlier start).  ``kept`` is binary: cuts fall between any bytes.

    A null text counts as empty; null ids come first.  Rows that share an id follow each other by a hash of
    the text, as if one text (no string crosses them).  Strings are judged on the input.  ``length`` is 64
    to 128.  Other columns are not read.
    """
    import numpy as np
    import pyarrow as pa

    if not HALF <= length <= 2 * HALF:
        raise ValueError(f"length {length} is not from {HALF} to {2 * HALF}")
    rows = _placed(docs, id_col, text_col)
    spans = repeated_spans(rows.select("d", "base", "data"), length).groupBy("d").agg(F.collect_list(F.struct("p", "n")).alias("spans"))

    def cut(batches):
        for batch in batches:
            ids, bases, texts = batch.column(0), batch.column(1).to_pylist(), _texts(batch, 2)
            lists = batch.column(3)
            bounds = lists.offsets.to_numpy()
            p, n = (lists.values.field(i).to_numpy() for i in (0, 1))
            out = []
            for k, (base, data) in enumerate(zip(bases, texts, strict=True)):
                a, b = bounds[k], bounds[k + 1]
                if not lists.is_valid()[k].as_py() or a == b:
                    out.append((len(data), 0, 0, data))
                    continue
                at = p[a:b] - base
                mine = (at >= 0) & (at < len(data))
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, at[mine], 1)
                np.add.at(edge, at[mine] + n[a:b][mine] + length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(data) else 0
                out.append((len(data), int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = _packed(rows).join(spans, "d", "left").select("doc_id", "base", "data", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of all documents, at 100 bytes."""
    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The same by plain means: every string of 100 bytes, in hexadecimal.
OP9_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(n - 99)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS place FROM w) WHERE place > 1),
o AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) + 100 AS fresh FROM r),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM o) GROUP BY doc_id, span),
g AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
k AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS left_over FROM g JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(left_over, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
