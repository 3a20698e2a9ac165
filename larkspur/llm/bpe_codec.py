"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves hold the merge rank of the pair that starts at each live symbol; an inner node holds the least
of its children, the left one on ties, so the root yields the leftmost lowest-rank merge.  A merge changes
three leaves, each in logarithmic time, and merging ends when the root holds no rank.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import pairwise

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import COMMON_WORD, ODD_CHARACTER, Vocabulary, vocabulary, vocabulary_path
from .common import Memo, each, let_go, table, worker_cache


def merged_symbols(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The symbols left when no adjacent pair has a rank any more.  ``symbols`` is used up."""
    n = len(symbols)
    if n < 2:
        return symbols
    none = len(ranks)
    size = 1 << (n - 1).bit_length()
    get = ranks.get
    level = [get(pair, none) for pair in pairwise(symbols)]
    level += [none] * (size - len(level))
    levels = [level]
    while len(level) > 1:
        level = list(map(min, level[::2], level[1::2]))
        levels.append(level)
    tree = [none, *(x for level in reversed(levels) for x in level)]

    def put(node: int, rank: int) -> None:
        if tree[node] == rank:
            return
        tree[node] = rank
        while node > 1:
            other = tree[node ^ 1]
            node >>= 1
            least = rank if rank <= other else other
            if tree[node] == least:
                return
            tree[node] = rank = least

    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    while (least := tree[1]) != none:
        node = 1
        while node < size:
            node *= 2
            if tree[node] != least:
                node += 1
        i = node - size
        j = right[i]
        symbols[i] = a = symbols[i] + symbols[j]
        symbols[j] = None
        right[i] = k = right[j]
        if k < n:
            put(size + j, none)
            left[k] = i
            put(node, get((a, symbols[k]), none))
        else:
            put(node, none)
        if (p := left[i]) >= 0:
            put(size + p, get((symbols[p], a), none))
    return [s for s in symbols if s is not None]


class Codec:
    """Encodes and decodes whole texts under one vocabulary, remembering pieces that recur."""

    def __init__(self, vocab: Vocabulary):
        if vocab.rules != "words":
            raise ValueError("this codec splits texts at spaces, which the vocabulary must drop, by rules it must know")
        self.vocab = vocab
        # identifiers alone, as decimal text: these tables are most of a worker's memory, and names decode them fast
        self.units = Memo(self._unit, 100_000)
        self.words = Memo(lambda part: self._text(self._merged(vocab.letters(part))), 300_000)
        self.plain = self.words  # pre-tokens of units are words, too
        self.names = {str(i): t for i, t in vocab.texts.items()}

    def _merged(self, letters: str) -> list[int]:
        vocab = self.vocab
        return [vocab.ids[s] for s in merged_symbols(vocab.symbols(letters), vocab.ranks)]

    def _ids(self, unit: str) -> list[int]:
        ids = []
        for token, letters in self.vocab.pieces(unit):
            ids += [self.vocab.added[token]] if token else self._merged(letters)
        return ids

    @staticmethod
    def _text(ids: list[int]) -> str:
        return " ".join(map(str, ids))

    def _unit(self, unit: str) -> str:
        parts = self.vocab.plain(unit)
        return self._text(self._ids(unit)) if parts is None else " ".join(map(self.plain.__getitem__, parts))

    def encode(self, text: str | None) -> list[int]:
        """The identifiers of a text; none for null and for empty texts."""
        return [int(i) for unit in (text or "").split(" ") if unit for i in self.units[unit].split()]

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by spaces, as the library decodes where a vocabulary names no decoder;
        identifiers that the vocabulary lacks are left out, as there."""
        texts = self.vocab.texts
        return " ".join(texts[i] for i in ids if i in texts)

    def encoded(self, text: str | None) -> tuple[int, str, str]:
        """(count, identifiers as decimal text, decoded text)."""
        return self._decoded(" ".join(filter(None, map(self.units.__getitem__, (text or "").split(" ")))))

    def _decoded(self, ids: str) -> tuple[int, str, str]:
        found = ids.split()
        return len(found), ids, " ".join(map(self.names.__getitem__, found))

    def all_encoded(self, texts):
        """(count, identifiers as decimal text, decoded text) of each of some texts; null: empty.  Texts of common characters
        alone are cut into pre-tokens by one match each, all others unit by unit."""
        for text in texts:
            if not text or ODD_CHARACTER.search(text):
                yield self.encoded(text)
                continue
            yield self._decoded(" ".join(map(self.words.__getitem__, COMMON_WORD.findall(text.lower()))))


@worker_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each worker process: its memo tables, which are bounded, serve all tasks of the worker."""
    return Codec(vocabulary(path))


def encode_documents(docs: DataFrame, vocabulary_file: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids`` for each row of ``docs``, without a shuffle.

    A null text counts as empty (no ids); a null id stays null; repeated rows give repeated rows; other
    columns are not read.
    """
    import pyarrow as pa

    path = vocabulary_path(vocabulary_file)

    def encode(batches):
        let_go(codec)
        own = codec(path)
        for batch in batches:
            ids = [own.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>")


def decode_ids(encoded: DataFrame, vocabulary_file: str = "word_bpe_49k.json") -> DataFrame:
    """``doc_id, text`` for each row of ``doc_id, ids``; null ids decode to an empty text."""
    import pyarrow as pa

    path = vocabulary_path(vocabulary_file)

    def decode(batches):
        let_go(codec)
        own = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(decode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def encoded_digests(docs: DataFrame, vocabulary_file: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: each text encoded, decoded again and digested
    where it is, without a shuffle.  Nulls and repeated rows as in ``encode_documents``."""
    import pyarrow as pa

    path = vocabulary_path(vocabulary_file)

    def digest(batches):
        let_go(codec)
        own = codec(path)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for n, a, b in own.all_encoded(each(batch.column(1))):
                counts.append(n)
                ids.append(sha256(a.encode()).hexdigest())
                decoded.append(sha256(b.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(digest, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of all documents."""
    return encoded_digests(table(spark, sf_dir, "documents"))
