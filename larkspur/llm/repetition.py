"""Quality rules on repetition inside a text, from a suffix array with longest common prefixes.

The words of several texts are one array of ranks in which a rank belongs to one text, so no match
crosses texts.  Prefix doubling sorts (rank, rank at the offset) pairs, only those still tied; the kept
ranks of each level give the longest common prefix of neighbours in the suffix array.  A suffix lies in
LCP intervals down to the larger of its two neighbours' values: that deepest interval is its longest
repeated substring, and these cover all maximal repeated substrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Texts go into one suffix array until they have so many words (a longer text has one of its own).
CHUNK_WORDS = 300_000
_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def longest_repeats(ids, ends):
    """For each place of a word array made of texts that end before ``ends``: the most words from there
    (inside the text) that also start at another place of that text; and the ranks of 8-word windows."""
    import numpy as np

    n = len(ids)
    starts = np.concatenate([[0], ends[:-1]])
    text = np.repeat(np.arange(len(ends)), ends - starts)
    left = ends[text] - np.arange(n)  # words to the end of the text
    key = text.astype(np.int64) * (int(ids.max()) + 1) + ids
    _, dense, counts = np.unique(key, return_inverse=True, return_counts=True)
    order_key = (np.cumsum(counts) - counts)[dense]  # a rank is the group's first place in the suffix array
    levels, h = [order_key], 1
    tied = np.flatnonzero(counts[dense] > 1)
    while len(tied):
        rank = order_key
        # the rank h further on inside the text, 0 beyond it: shorter suffixes come first
        ahead = np.where(left[tied] > h, rank[np.minimum(tied + h, n - 1)] + 1, 0)
        order = np.lexsort((ahead, rank[tied]))
        at, r, a = tied[order], rank[tied][order], ahead[order]
        new_group = np.concatenate([[True], r[1:] != r[:-1]])
        new = new_group | np.concatenate([[True], a[1:] != a[:-1]])
        first = np.flatnonzero(new_group)
        # a tied group of rank q holds ranks q, q + 1, ...: ranks are starts in the suffix array
        group_start = np.repeat(first, np.diff(np.concatenate([first, [len(at)]])))
        last_new = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        order_key = rank.copy()
        order_key[at] = r + (last_new - group_start)
        h *= 2
        levels.append(order_key)
        size = np.diff(np.concatenate([np.flatnonzero(new), [len(at)]]))
        still = np.repeat(size > 1, size)
        tied = np.sort(at[still])
    sa = np.argsort(order_key, kind="stable")
    a, b = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(max(n - 1, 0), np.int64)
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    for level in range(len(levels) - 1, -1, -1):
        if not len(live):
            break
        step = 1 << level
        x, y = a[live], b[live]
        inside = (x < n) & (y < n)
        xx, yy = np.minimum(x, n - 1), np.minimum(y, n - 1)
        same = inside & (text[xx] == text[yy]) & (left[xx] >= step) & (left[yy] >= step) & (levels[level][xx] == levels[level][yy])
        got = live[same]
        a[got] += step
        b[got] += step
        lcp[got] += step
    longest = np.zeros(n, np.int64)
    if n > 1:
        longest[sa[:-1]] = lcp
        longest[sa[1:]] = np.maximum(longest[sa[1:]], lcp)
    return longest


def covered(longest, ends, least: int):
    """Per text: words covered by repeated runs of ``least`` words or more, and the longest such run."""
    import numpy as np

    n = len(longest)
    reach = np.where(longest >= least, np.arange(n) + longest, 0)
    far = np.maximum.accumulate(reach)
    mark = np.concatenate([[0], np.cumsum(far > np.arange(n))])
    starts = np.concatenate([[0], ends[:-1]])
    top = np.where(longest >= least, longest, 0)
    most = np.zeros(len(ends), np.int64)
    some = ends > starts
    if n:
        most[some] = np.maximum.reduceat(top, starts[some])
    return mark[ends] - mark[starts], most


def _measures(texts: list[str | None], windows: int, least: int):
    """Per text: words, characters in words, symbols, repeated lines, words in repeated windows, words
    covered by repeated runs, the longest such run."""
    import numpy as np

    out, number, ids, ends, at = [], {}, [], [], 0
    pending = []

    def flush():
        nonlocal number, ids, ends, at
        if ids:
            e = np.asarray(ends)
            longest = longest_repeats(np.asarray(ids, np.int64), e)
            window, _ = covered(np.where(longest >= windows, windows, 0), e, windows)
            cover, most = covered(longest, e, least)
        else:
            window = cover = most = np.zeros(len(ends), np.int64)
        out.extend((*p, int(w), int(c), int(m)) for p, w, c, m in zip(pending, window, cover, most, strict=True))
        number, ids, ends, at = {}, [], [], 0
        pending.clear()

    for text in texts:
        text = text or ""
        found = text.encode("utf-8", "surrogatepass").split()
        lines = [line for line in text.split("\n") if line.strip(_SPACE)]
        pending.append((len(found), len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines))))
        ids.extend([number.setdefault(w, len(number)) for w in found])
        at += len(found)
        ends.append(at)
        if at >= CHUNK_WORDS:
            flush()
    flush()
    return out


def repetition_rules(
    docs: DataFrame, windows: int = 8, least_words: int = 20, max_window_percent: int = 30, least_repeat: int = 4, max_covered: float = 0.3, max_repeat: int = 200, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, longest_repeat,
    base_failed, kept`` for each row of ``docs``, without a shuffle.

    The base rule fails texts under ``least_words`` words, or with over ``max_window_percent`` percent of
    the words in ``windows``-word windows found twice or more.  The method's verdict: repeated runs of
    ``least_repeat`` words or more cover at most ``max_covered`` of the words, and none is longer than
    ``max_repeat`` words.  A null text counts as empty (and fails); null ids and repeated rows stay;
    other columns are not read.
    """
    import pyarrow as pa

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"]

    def measure(batches):
        for batch in batches:
            rows = _measures(batch.column(1).to_pylist(), windows, least_repeat)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(7))], names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(measure, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in names[1:]))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > max_window_percent * F.col("n_words"))
    verdict = (F.col("n_covered") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_repeat)
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict)


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` of all documents; a null or
    empty text has no words and fails the base."""
    return repetition_rules(table(spark, sf_dir, "documents"))
