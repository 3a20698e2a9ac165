"""Each registered query itself: against its SQL where it has one, else its columns and rows."""

import re
import zlib
from hashlib import sha256
from pathlib import Path

import duckdb
import pytest

from larkspur.llm.bpe import library_tokenizer, vocabulary_path
from larkspur.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, con, name):
    got, want = queries()[name](spark, SF), con.sql(oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted(repr(tuple(r[c] for c in order)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


COLUMNS = {
    "op1_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op4_repetition": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op5_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op7_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op8_bpe_codec": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op12_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, con, name):
    got = queries()[name](spark, SF)
    assert set(COLUMNS[name]) <= set(got.columns)
    assert got.select("doc_id").distinct().count() == got.count() == con.sql("SELECT count(*) FROM documents").fetchall()[0][0]


def texts_of(con):
    return {i: t or "" for i, t in con.sql("SELECT doc_id, text FROM documents").fetchall()}


def test_token_files_row_by_row(spark, con):
    library, start, want = library_tokenizer(vocabulary_path("byte_bpe_50k.json")), 0, {}
    for i, text in sorted(texts_of(con).items()):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries()["op1_token_files"](spark, SF).collect()} == want


def test_quality_row_by_row(spark, con):
    texts = texts_of(con)
    for r in queries()["op4_repetition"](spark, SF).collect():
        text = texts[r.doc_id]
        words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = {}
        for k in range(len(words) - 7):
            windows.setdefault(tuple(words[k : k + 8]), []).append(k)
        repeated = {k + j for found in windows.values() if len(found) > 1 for k in found for j in range(8)}
        base = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), base)
        assert not (base and r.kept)


def test_token_counts_row_by_row(spark, con):
    library = library_tokenizer(vocabulary_path("byte_bpe_50k.json"))
    want = {i: (len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 512) for i, t in texts_of(con).items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries()["op7_token_counts"](spark, SF).collect()} == want


def test_codec_row_by_row(spark, con):
    library, want = library_tokenizer(vocabulary_path("word_bpe_49k.json")), {}
    for i, text in texts_of(con).items():
        ids = library.encode(text, add_special_tokens=False).ids
        want[i] = (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries()["op8_bpe_codec"](spark, SF).collect()} == want
