"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token starts as one symbol for each byte.  A heap holds adjacent pairs by (merge rank, place); the
lowest is popped, its right symbol unlinked, and the pairs with the new neighbours pushed.  The count is
initial symbols minus merges: no identifiers are looked up or emitted.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Vocabulary, distinct_units, is_loose, loose_units, text_chunks, units, vocabulary, vocabulary_path
from .common import Memo, let_go, table, worker_cache


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left when no adjacent pair has a rank any more.  ``symbols`` is used up."""
    n = len(symbols)
    if n < 2:
        return n
    heap = [(rank, i) for i in range(n - 1) if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapify(heap)
    right, left, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
    while heap:
        rank, i = heappop(heap)
        a, j = symbols[i], right[i]
        if a is None or j >= n or ranks.get((a, symbols[j])) != rank:
            continue  # the pair is gone or has another rank now
        symbols[i] = a = a + symbols[j]
        symbols[j] = None
        merges += 1
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            if (rank := ranks.get((a, symbols[k]))) is not None:
                heappush(heap, (rank, i))
        if (p := left[i]) >= 0 and (rank := ranks.get((symbols[p], a))) is not None:
            heappush(heap, (rank, p))
    return n - merges


class TokenCounter:
    """Token counts of whole texts under one vocabulary, remembering pieces that recur."""

    def __init__(self, vocab: Vocabulary):
        if vocab.rules != "bytes":
            raise ValueError("this counter cuts texts at spaces, which the vocabulary's rules must allow")
        self.vocab = vocab
        self.pre_tokens = Memo(lambda p: merged_count(vocab.symbols(p), vocab.ranks), 200_000)
        self.heads = Memo(self._unit, 50_000)
        self.spaced = Memo(lambda unit: self._unit(" " + unit), 200_000)

    def _unit(self, unit: str) -> int:
        return sum(1 if token else self.pre_tokens[p] for token, p in self.vocab.pieces(unit))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if is_loose(text):
            return sum(map(self.heads.__getitem__, loose_units(text)))
        first, rest = units(text)
        return self.heads[first] + sum(map(self.spaced.__getitem__, rest))

    def counts(self, texts):
        """The counts of an Arrow array of texts; null: 0.  A distinct unit of a chunk is looked up once."""
        import numpy as np

        out = [np.zeros(0, np.int64)]
        for chunk in text_chunks(texts):
            names, extra, codes, bounds = distinct_units(chunk)
            size = np.asarray([*map(self.spaced.__getitem__, names.to_pylist()), *map(self.heads.__getitem__, extra)], np.int64)
            out.append(np.diff(np.concatenate([[0], np.cumsum(size[codes])])[bounds]))
        return np.concatenate(out)


@worker_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    """One counter for each worker process: its memo tables, which are bounded, serve all tasks of the worker."""
    return TokenCounter(vocabulary(path))


def token_counts(docs: DataFrame, vocabulary_file: str = "byte_bpe_50k.json", limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs``, without a shuffle.

    A null text counts as empty (0 bytes, 0 tokens, not over the limit); a null id stays null; repeated
    rows give repeated rows; other columns are not read.  An empty table gives an empty result.
    """
    import pyarrow as pa

    path = vocabulary_path(vocabulary_file)

    def count(batches):
        let_go(counter)
        own = counter(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.counts(batch.column(2)), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    return rows.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of all documents."""
    return token_counts(table(spark, sf_dir, "documents"))
