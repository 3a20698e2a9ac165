"""Texts without spaces and very long lines: memory and time stay bounded."""

from larkspur.llm.bpe import vocabulary, vocabulary_path
from larkspur.llm.bpe_codec import Codec
from larkspur.llm.common import Memo
from larkspur.llm.token_count import TokenCounter


def test_memo_keeps_no_long_keys():
    memo = Memo(len, 100)
    assert memo["x" * 65] == 65 and memo["x" * 64] == 64 and memo[b"y" * 500] == 500
    assert list(memo) == ["x" * 64]


def test_texts_without_spaces_are_not_remembered():
    texts = ["".join(chr(0x4E00 + (7 * i + k) % 3000) for k in range(500)) for i in range(20)]
    counter, codec = TokenCounter(vocabulary(vocabulary_path("byte_bpe_50k.json"))), Codec(vocabulary(vocabulary_path("word_bpe_49k.json")))
    for text in texts:
        assert counter.count(text) == len(counter.vocab.library.encode(text, add_special_tokens=False).ids)
        assert codec.encode(text) == codec.vocab.library.encode(text, add_special_tokens=False).ids
    for memo in (counter.pre_tokens, counter.heads, counter.spaced, codec.units, codec.plain):
        assert sum(len(k) for k in memo) <= Memo.LONGEST * len(memo)
    assert not codec.units and not counter.heads


def test_common_and_odd_texts_are_encoded_as_by_the_library():
    import random

    codec, rnd = Codec(vocabulary(vocabulary_path("word_bpe_49k.json"))), random.Random(6)
    library = codec.vocab.library
    pieces = ["Straße", "ÀÉÎ", "don't", "it's'd", "<|endoftext|>", "a<b", "x_y", "\\", '"quoted"', "--->", "3.14", "007", "e-mail@x.org", "#1!", "…", "日本", "ª", "­", "\t", "\r\n", "\n", " ", "  ", "[]{}~`^", "É́", "ﬁ", "İ"]
    texts = [None, "", *pieces, *("".join(rnd.choice(pieces) + rnd.choice(["", " ", "\n"]) for _ in range(12)) for _ in range(300))]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert list(codec.all_encoded(texts)) == [(len(i), " ".join(map(str, i)), library.decode(i, skip_special_tokens=False)) for i in want]
