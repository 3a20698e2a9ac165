import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from tokenizers import Tokenizer

from larkspur.llm.bpe import vocabulary, vocabulary_path
from larkspur.llm.bpe_codec import Codec, decode_ids, encode_documents, encoded_digests, merged_symbols
from larkspur.llm.common import new_path
from larkspur.llm.token_count import TokenCounter, merged_count, token_counts
from larkspur.llm.token_files import read_token_files, write_token_files

ODD = [
    None, "", " ", "  ", "\n", " \n ", "a", "  two  spaces ", "tab\tand\r\nline \n end", "it's they'll  'S x's", "<|endoftext|>", "a<|endoftext|> b <|startoftext|>c",
    "naïve café ÉÉ Σίσυφος ΣΑΣ ΑΣ", "é ́x ñ", " nbsp  x y　z", "a\x1cb !\x1c! \x85 c\x0bd", "日本語のテキスト。 漢字", "🙂👍🏽 emoji", "12345 6.7.8 ½ ²",
    "!!!???... ---", "x" * 3000, "ab " * 500, "a​b﻿", "ﬁ ﬂ Ⅷ ǅ ß ẞ İ ı",
]


def texts():
    rng = random.Random(5)
    letters = "ab c d  eE'sté\n\t.,!|1Σß́<|> "
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(600)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int")


def naive_merge(symbols, ranks):
    symbols = list(symbols)
    while len(symbols) > 1:
        rank, i = min((ranks.get((symbols[i], symbols[i + 1]), len(ranks)), i) for i in range(len(symbols) - 1))
        if rank == len(ranks):
            break
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    return symbols


def test_merging_equals_naive_merging():
    vocab = vocabulary(vocabulary_path("byte_bpe_50k.json"))
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.choice("abcdefinorst") for _ in range(rng.randint(0, 40))]
        want = naive_merge(s, vocab.ranks)
        assert merged_symbols(list(s), vocab.ranks) == want
        assert merged_count(list(s), vocab.ranks) == len(want)


def test_counts_equal_the_library():
    path = vocabulary_path("byte_bpe_50k.json")
    own, library = TokenCounter(vocabulary(path)), Tokenizer.from_file(path)
    for t in texts():
        assert own.count(t) == len(library.encode(t or "", add_special_tokens=False).ids), repr(t)


def test_codec_equals_the_library():
    path = vocabulary_path("word_bpe_49k.json")
    own, library = Codec(vocabulary(path)), Tokenizer.from_file(path)
    for t in texts():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert own.encode(t) == ids, repr(t)
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False), repr(t)
        assert own.encoded(t) == (len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)), repr(t)


def test_count_query_rows(spark):
    rows = [(i, t, "x", 7) for i, t in enumerate(ODD)] + [(None, "abc", None, None), (0, None, "x", 7)]
    got = token_counts(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id > 0}
    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    for i, t in enumerate(ODD[1:], 1):
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (by[i].n_bytes, by[i].n_tokens, by[i].over_limit) == (len(t.encode()), n, n > 512)
    assert token_counts(frame(spark, [])).count() == 0


def test_codec_round_trip_rows(spark):
    docs = frame(spark, [(i, t, "x", 7) for i, t in enumerate(ODD)])
    library = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    for r in encoded_digests(docs).collect():
        ids = library.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    coded = encode_documents(docs)
    back = {r.doc_id: r.text for r in decode_ids(coded).collect()}
    assert back[10] == "<|endoftext|>" and back[0] == ""
    assert encoded_digests(frame(spark, [])).count() == 0


def test_token_files(spark):
    every = texts()
    rows = [(i * 3, t, "x", 7) for i, t in enumerate(every)] + [(None, "null id", "x", 7), (9, "again", None, None)]
    random.Random(2).shuffle(rows)
    out = new_path(spark, "tokens")
    manifest = write_token_files(frame(spark, rows).repartition(5), out)
    assert len(manifest) > 1 and manifest[0]["n_null"] == 1
    got = {(r.doc_id, r.start): r for r in read_token_files(spark, out).collect()}
    library, start = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json")), 0
    for doc, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        r = got.pop((doc, start))
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got


def test_token_files_of_nothing(spark):
    out = new_path(spark, "tokens")
    write_token_files(frame(spark, []), out)
    assert read_token_files(spark, out).count() == 0


@pytest.mark.parametrize("cap", [2, 10])
def test_memo_is_bounded(cap):
    from larkspur.llm.common import Memo

    memo = Memo(str, cap)
    assert [memo[i] for i in [*range(30), *range(30)]] == [str(i) for i in [*range(30), *range(30)]]
    assert len(memo) <= cap and len(memo.old) <= cap
