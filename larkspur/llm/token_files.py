"""Token-ID output: flat unsigned integer files with 64-bit document offsets, memory-mapped on reading.

Documents are range-partitioned and sorted by id; each task writes one part: ``.ids`` (unsigned 16-bit
where the vocabulary has at most 65,536 ids, else 32-bit, little-endian), ``.off`` (n + 1 64-bit token
offsets in the part) and ``.doc`` (64-bit document ids).  A part's base is the prefix sum of the token
counts of the parts before it, kept with the part's name in the manifest.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import LETTERS, MARKS, byte_letters, distinct_units, library_tokenizer, text_chunks, vocabulary, vocabulary_path
from .common import Files, let_go, new_path, table, worker_cache


#: Units of letters, then marks; once more after one newline.  Anything else is encoded as it is.
_UNIT = rf"^(?P<a>[{LETTERS}]+)(?P<b>[{MARKS}]*)(?P<c>(?:\n[{LETTERS}]+)?)(?P<d>[{MARKS}]*)$"


class Encoder:
    """The library's identifiers of whole texts.  Texts are cut into units; each distinct unit of a chunk goes
    to the library once: its pre-tokens to the library's model, where a pattern tells them, else the unit as
    a text.  A vocabulary whose rules are not known to allow that has its texts encoded whole."""

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.vocab = library_tokenizer(path), vocabulary(path)
        size = 1 + max(self.library.get_vocab(with_added_tokens=True).values())
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        #: The same model over words that are parted by spaces.
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.letters = {**{ord(chr(b)): c for b, c in byte_letters().items()}, 0xFF: " "}  # no text has a byte 0xFF
        self.width = np.zeros(size, np.int64)
        for token, number in self.library.get_vocab(with_added_tokens=False).items():
            self.width[number] = len(token)
        self.known = self.vocab.rules == "bytes" and all(c in self.vocab.ids for c in byte_letters().values())

    def _encoded(self, texts: list[str]):
        """(identifiers, how many each text has), each text encoded as it is."""
        import numpy as np

        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.asarray([i for ids in found for i in ids], self.dtype), np.asarray([len(x) for x in found], np.int64)

    def _words(self, words: list[str]):
        """(identifiers, how many each word has) of pre-tokens, by the model."""
        import numpy as np

        if not words:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        data = [w.encode() for w in words]
        joined = [b"\xff".join(data[i : i + 1000]).decode("latin-1").translate(self.letters) for i in range(0, len(data), 1000)]
        ids = np.concatenate([np.asarray(e.ids, self.dtype) for e in self.model.encode_batch_fast(joined, add_special_tokens=False)])
        # no identifier crosses words, so a word ends where as many letters are used up
        ends, letters = np.cumsum([len(x) for x in data]), np.cumsum(self.width[ids])
        to = np.searchsorted(letters, ends, "right")
        if not np.array_equal(letters[to - 1], ends):
            raise ValueError(f"{self.vocab.path}: the model's tokens do not cover its words")
        return ids, np.diff(to, prepend=0)

    def _units(self, names, extra: list[str]):
        """(identifiers, how many each has) of the units after one space ``names``, then of ``extra``."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        found = pc.extract_regex(names, _UNIT)
        plain = found.is_valid().to_numpy(zero_copy_only=False)
        parts = [found.field(k).filter(found.is_valid()) for k in range(4)]
        parts[2] = pc.utf8_slice_codeunits(parts[2], 1)  # without its newline
        heads = parts[0].dictionary_encode()
        rest = pa.concat_arrays(parts[1:]).dictionary_encode()
        words, tails = heads.dictionary.to_pylist(), rest.dictionary.to_pylist()
        whole = [" " + u for u in names.filter(pa.array(~plain)).to_pylist()] + extra
        (a, na), (b, nb) = self._words([" " + w for w in words] + ["\n"] + [t for t in tails if t]), self._encoded(whole)
        # the entries: nothing, words, a newline, tails, and units that were encoded whole
        size = np.concatenate([[0], na, nb])
        tail = np.asarray([bool(t) for t in tails], bool)
        number = np.where(tail, 1 + len(words) + np.cumsum(tail), 0)
        table = np.zeros((len(names) + len(extra), 5), np.int64)
        at = np.flatnonzero(plain)
        b1, c1, d1 = number[rest.indices.to_numpy()].reshape(3, len(at)) if len(at) else np.zeros((3, 0), np.int64)
        table[at, 0] = 1 + heads.indices.to_numpy()
        table[at, 1], table[at, 2], table[at, 3], table[at, 4] = b1, np.where(c1 > 0, 1 + len(words), 0), c1, d1
        table[np.concatenate([np.flatnonzero(~plain), np.arange(len(names), len(table))]), 0] = 1 + len(na) + np.arange(len(nb))
        return _gathered(np.concatenate([a, b]), size, table.ravel()), size[table].sum(1)

    def tokens(self, texts):
        """(identifiers of all texts, how many each text has) of an Arrow array of texts; null: none."""
        import numpy as np

        if not self.known:
            return self._encoded([t or "" for t in texts.to_pylist()])
        names, extra, codes, bounds = distinct_units(texts)
        ids, size = self._units(names, extra)
        return _gathered(ids, size, codes), np.diff(np.concatenate([[0], np.cumsum(size[codes])])[bounds])


def _gathered(pool, size, codes):
    """The entries of ``pool`` (``size``: how long each is) numbered ``codes``, in that order."""
    import numpy as np

    start, sizes = np.cumsum(size) - size, size[codes]
    at = np.repeat(start[codes] - np.cumsum(sizes) + sizes, sizes)
    at += np.arange(len(at))
    return pool[at]


@worker_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_token_files(docs: DataFrame, out: str, vocabulary_file: str = "byte_bpe_50k.json", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Write all documents, in ascending id order, as parts below ``out``; return the manifest, one
    entry a part in order: name, base, n_tokens, n_docs, n_null, dtype.  The manifest is also written.

    Every document gets ``end_id`` after its tokens; a null text counts as empty.  Null ids come first;
    rows with equal ids follow each other by text.  Other columns are not read; an empty table gives an
    empty manifest.  Texts of any length are encoded whole; memory follows the longest text (about ten times
    its bytes) or a chunk of texts, whichever is more.  Parts are written under their final name only when whole, and the same rows give
    the same bytes, so tasks may be run again.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    path = vocabulary_path(vocabulary_file)
    dtype = encoder(path).dtype.str

    def write(batches):
        let_go(encoder)
        own, files = encoder(path), Files(out)
        name = f"part-{TaskContext.get().partitionId():06d}"
        sizes, ids = [np.zeros(1, "<i8")], [pa.array([], pa.int64())]

        def chunks():
            for batch in batches:
                ids.append(batch.column(0))
                for texts in text_chunks(batch.column(1)):
                    tokens, size = own.tokens(texts)
                    sizes.append(size + 1)
                    yield np.insert(tokens, np.cumsum(size), end_id).tobytes()

        files.write(f"{name}.ids", chunks())
        offsets = np.cumsum(np.concatenate(sizes)).astype("<i8")
        files.write(f"{name}.off", [offsets.tobytes()])
        docs_of = pa.chunked_array(ids)
        files.write(f"{name}.doc", [docs_of.fill_null(0).to_numpy().astype("<i8").tobytes()])
        yield pa.RecordBatch.from_pydict({"name": [name], "n_tokens": [int(offsets[-1])], "n_docs": [len(docs_of)], "n_null": [docs_of.null_count]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, "name string, n_tokens long, n_docs long, n_null long")
    manifest, base = [], 0
    for part in sorted((r.asDict() for r in parts.collect()), key=lambda r: r["name"]):  # a row a part
        if part["n_docs"]:
            manifest.append(part | {"base": base, "dtype": dtype})
            base += part["n_tokens"]
    Files(out).write("manifest.json", [json.dumps(manifest).encode()])
    return manifest


def read_token_files(spark: SparkSession, out: str, manifest: list[dict] | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files below ``out``: the parts
    are mapped, and each document's ids are the slice between its offsets."""
    import zlib

    import numpy as np
    import pyarrow as pa

    if manifest is None:
        with Files(out).open("manifest.json") as f:
            manifest = json.loads(f.read())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches):
        files = Files(out)
        for batch in batches:
            for part in batch.to_pylist():
                ids, offsets, docs = (files.array(f"{part['name']}.{kind}", d) for kind, d in (("ids", part["dtype"]), ("off", "<i8"), ("doc", "<i8")))
                if len(docs) != part["n_docs"] or offsets[-1] != len(ids) or len(ids) != part["n_tokens"]:
                    raise ValueError(f"{out}/{part['name']}: the files do not match the manifest")
                crcs = np.fromiter((zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(offsets[:-1], offsets[1:], strict=True)), "<i8", len(docs))
                known = np.arange(len(docs)) >= part["n_null"]
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(docs), mask=~known), pa.array(offsets[:-1] + part["base"]), pa.array(np.diff(offsets)), pa.array(crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    if not manifest:
        return spark.createDataFrame([], schema)
    parts = spark.createDataFrame(manifest, "name string, n_tokens long, n_docs long, n_null long, base long, dtype string")
    return parts.repartition(len(manifest)).mapInArrow(read, schema)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of all documents, from the token files written and read back."""
    out = new_path(spark, "tokens")
    return read_token_files(spark, out, write_token_files(table(spark, sf_dir, "documents"), out))
