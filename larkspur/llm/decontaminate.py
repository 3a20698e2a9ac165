"""Benchmark decontamination with a generalised suffix automaton over item words.

The automaton accepts every run of words of every item.  A document's words are streamed through it: the
state and the length of the longest match that ends at each word are kept.  Where the length reaches the
window, the last ``window`` words are hit; where it covers a whole item shorter than the window, that
item's words are.  A word is the longest run of ASCII digits, letters (A-Z lower-cased) and non-ASCII
characters; bytes do as well as characters here, as all bytes of a non-ASCII character are over 0x7F.
"""

from __future__ import annotations

import json
import re
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Files, let_go, new_path, table, worker_cache

_TO_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

#: Items are in blocks of at most so many words (a longer item is a block of its own); a worker keeps the automata
#: of so many blocks, and where there are more, takes so many bytes of rows past each.
BLOCK_WORDS, KEPT, BUFFER = 100_000, 2, 32 << 20


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


class Automaton:
    """The generalised suffix automaton of the items of one block."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, str]] = []
        shorts: list[tuple[list[bytes], str]] = []
        for item, text in items:
            run, last = words(text), 0
            for word in run:
                last = self._extend(last, word)
            if run:
                ends.append((run, item))
                if len(run) < window:
                    shorts.append((run, item))
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        found: list[set[str]] = [set() for _ in self.link]  # items that hold a state's strings
        for run, item in ends:
            v = 0
            for word in run:
                v = self.next[v][word]
                u = v
                while u > 0 and item not in found[u]:
                    found[u].add(item)
                    u = self.link[u]
        #: Per state: the items that hold the last ``window`` words of a long enough match.
        self.items: list[frozenset[str] | None] = [None] * len(self.link)
        #: Per state: (length, item) of the whole short items that a match in this state ends with.
        self.short: list[tuple] = [()] * len(self.link)
        own: dict[int, set] = {}
        for run, item in shorts:
            v = 0
            for word in run:
                v = self.next[v][word]
            own.setdefault(v, set()).add((len(run), item))
        for v in order:
            up = self.link[v]
            if self.length[v] >= window:
                self.items[v] = frozenset(found[v]) if self.length[up] < window else self.items[up]
            self.short[v] = self.short[up] + tuple(sorted(own.get(v, ())))

    def _extend(self, last: int, word: bytes) -> int:
        """The state of the current item's prefix with one more word."""
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(word)) is not None:
            return q if length[q] == length[last] + 1 else self._split(last, word, q)
        new = len(link)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
        return new

    def _split(self, p: int, word: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(link)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = clone
            p = link[p]
        return clone

    def hits(self, run: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(merged hit spans as word offsets, items with an occurring window)."""
        nxt, link, length, window, short, items = self.next, self.link, self.length, self.window, self.short, self.items
        root = nxt[0]
        v = n = 0
        spans: list[tuple[int, int]] = []
        states: set[int] = set()
        found: set[str] = set()

        def mark(a: int, b: int) -> None:
            while spans and a <= spans[-1][1]:
                c, d = spans.pop()
                a, b = min(a, c), max(b, d)
            spans.append((a, b))

        for i, word in enumerate(run):
            if v:
                to = nxt[v].get(word)
                if to is None:
                    while v and (to := nxt[v].get(word)) is None:
                        v = link[v]
                    if v:
                        n = length[v]
                    else:
                        n, to = 0, root.get(word)
                if to is None:
                    continue
            elif (to := root.get(word)) is None:
                continue
            v, n = to, n + 1
            if n >= window:
                states.add(v)
                mark(i + 1 - window, i + 1)
            if short[v]:
                for size, item in short[v]:
                    if size <= n:
                        found.add(item)
                        mark(i + 1 - size, i + 1)
        return spans, found.union(*(items[s] for s in states))


@worker_cache(maxsize=KEPT)
def _automaton(root: str, k: int, window: int) -> Automaton:
    with Files(root).open(f"{k}.json") as f:
        return Automaton([tuple(item) for item in json.loads(f.read())], window)


def _write_blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> tuple[str, int]:
    """(folder, number) of block files of [id as text, text] pairs below the shared folder.  Items stream
    through the driver, which holds one block."""
    root, block, size, k = new_path(items.sparkSession, "items"), [], 0, 0
    files = Files(root)
    for row in items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")), F.col(f"`{text_col}`")).toLocalIterator():
        n = len(words(row[1]))
        if n and block and size + n > block_words:
            files.write(f"{k}.json", [json.dumps(block).encode()])
            block, size, k = [], 0, k + 1
        if n:
            block.append((row[0], row[1]))
            size += n
    if block:
        files.write(f"{k}.json", [json.dumps(block).encode()])
        k += 1
    return root, k


def _buffered(batches, least: int):
    """Lists of batches of at least so many bytes together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield held
            held, size = [], 0
    if held:
        yield held


def _matched(docs: DataFrame, items: DataFrame, window: int, finish, schema: str, item_id: str, item_text: str, block_words: int) -> DataFrame:
    """``docs`` (whose last column is the text) past the automaton of every block, then ``finish`` over
    (text, number of words, spans, items) of each row.  A task has one worker, which loads the blocks in turn: with
    more than it keeps, a buffer of rows goes past each block before the next buffer does, so that loading
    stays small beside matching.  Nothing is shuffled, and no block is sent to where it isn't asked for."""
    width = len(docs.columns)
    root, count = _write_blocks(items, item_id, item_text, block_words)

    def run(batches):
        let_go(_automaton)
        for held in _buffered(batches, BUFFER if count > KEPT else 0):
            rows = [[(text, 0, [], set()) for text in batch.column(width - 1).to_pylist()] for batch in held]
            for k in range(max(count, 1)):
                own = _automaton(root, k, window) if count else None
                for part in rows:
                    for i, (text, _, spans, found) in enumerate(part):
                        tokens = words(text)
                        more, other = own.hits(tokens) if own else ([], set())
                        part[i] = text, len(tokens), _union(spans, more) if spans and more else more or spans, found | other if other else found
            for batch, part in zip(held, rows, strict=True):
                yield finish(batch, part)

    return docs.mapInArrow(run, schema)


def _union(a, b) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted([*a, *b]):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for each row of ``docs``.

    Null texts have no words; items without words have no window; items with a null id count under the
    name "null"; items that share an id count once.  Null and repeated document ids stay as they are.
    Other columns are not read.  No items: nothing is hit.
    """
    import pyarrow as pa

    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]

    def finish(batch, rows):
        hit = [sum(b - a for a, b in r[2]) for r in rows]
        return pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([r[1] for r in rows], pa.int64()), pa.array(hit, pa.int64()), pa.array([len(r[3]) for r in rows], pa.int64()),
            pa.array([sha256(",".join(sorted(r[3])).encode()).hexdigest() for r in rows], pa.string()), pa.array([h > 0 for h in hit], pa.bool_()),
        ], names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _matched(rows, items, window, finish, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean", item_id, item_text, block_words)


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the bytes from the first to the last word of each span of word offsets."""
    data = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(data)]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_span: int = 0, max_coverage: float = 0.5, text_col: str = "text", length_col: str | None = None, item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with the same columns: hit spans of more than ``max_span`` words are cut out of the text,
    and rows of which more than ``max_coverage`` of the words are hit go altogether.

    Rows without hits are as they were, null and empty texts too.  ``length_col``: a column that is to
    hold the characters of the new text where it changed.
    """
    import pyarrow as pa

    names = docs.columns
    if len(set(names)) < len(names):
        raise ValueError(f"columns with equal names: {names}")
    held = [c for c in names if c != text_col]
    rows = docs.select(*[F.col(f"`{c}`") for c in held], F.col(f"`{text_col}`"))

    def finish(batch, out):
        keep, texts, sizes = [], [], []
        for k, (text, n_words, spans, _) in enumerate(out):
            if spans:
                if sum(b - a for a, b in spans) > max_coverage * n_words:
                    continue
                if cut := [s for s in spans if s[1] - s[0] > max_span]:
                    text = cut_spans(text, cut)
            keep.append(k)
            texts.append(text)
            sizes.append(len(text) if spans and text is not None else None)
        kept = batch.take(pa.array(keep, pa.int64()))
        columns = dict(zip(held, kept.columns, strict=False))
        columns[text_col] = pa.array(texts, batch.column(len(held)).type)
        if length_col:
            old = columns[length_col]
            columns[length_col] = pa.array([new if new is not None else was for new, was in zip(sizes, old.to_pylist(), strict=True)], old.type)
        return pa.RecordBatch.from_arrays([columns[c] for c in (*held, text_col)], [*held, text_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return _matched(rows, items, window, finish, schema, item_id, item_text, block_words).select(*[F.col(f"`{c}`") for c in names])


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of all documents against all items."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The same by plain means: all windows of all texts.
OP3_SQL = rf"""
WITH w AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
t AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT item, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' '))) AS k, 10 AS n FROM t WHERE len(w) >= 10
  UNION SELECT item, array_to_string(w, ' '), len(w) FROM t WHERE len(w) BETWEEN 1 AND 9),
d AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM w),
h AS (SELECT DISTINCT doc_id, i, k.n, item FROM d, (SELECT DISTINCT n FROM k) s JOIN k ON k.n = s.n WHERE len(l) >= k.n AND array_to_string(l[1:k.n], ' ') = k.k),
m AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
e AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_words FROM w GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN e USING (doc_id)
"""
