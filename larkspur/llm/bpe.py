"""Byte-pair vocabularies, and the splitting of whole texts into units that merge independently.

A pre-token of either vocabulary never runs from a non-space character into a following space, so a
text may be cut before every space that follows a non-space character, and each piece handled alone
(and remembered, as most pieces recur).  Added tokens hold no spaces and are cut out of a piece first.
"""

from __future__ import annotations

import json
import os
import re
from functools import cached_property

from .common import worker_cache

_SPACE_AFTER_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
#: Runs that need no library: Latin-1 letters (composed, with plain lower cases) and common marks.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?|%$#&*()"
_PLAIN = re.compile(rf" ?[{LETTERS}]+| ?[{MARKS}]+|\n")
#: Normalisers and pre-tokenisers of word vocabularies that drop spaces.
_WORD_STEPS = [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
_WORD_PARTS = [
    ("Split", {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "Removed", True, None, None),
    ("ByteLevel", None, None, None, False, False),
]
#: Of texts without odd characters a word vocabulary's pre-tokens are runs of letters, digits one by one, and runs of
#: marks.  Apostrophes (contractions) and < (added tokens) are odd, and so is what a normaliser could change.
_ANY_MARKS = re.escape("!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~")
ODD_CHARACTER = re.compile(rf"[^{LETTERS}0-9{_ANY_MARKS} \n]")
COMMON_WORD = re.compile(rf"[{LETTERS}]+|[0-9]|[{_ANY_MARKS}]+")
_PLAIN_WORDS = re.compile(rf"[{LETTERS}]+|[{MARKS}]+|[ \n]+")


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file is; a path is taken as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@worker_cache(maxsize=4)
def library_tokenizer(path: str):
    """The tokenizers library's own tokenizer of a vocabulary file, in this process alone."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 characters
    stand for themselves, all others for characters from U+0100 on in byte order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, extra = {}, 0x100
    for byte in range(256):
        letters[byte] = chr(byte if byte in plain else extra)
        extra += byte not in plain
    return letters


class Vocabulary:
    """Merge ranks, identifiers and splitting rules of one byte-pair vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path = path
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.ids = model["vocab"]
        self.word_end = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.texts = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.added.items()}
        self._added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._letters = {b: c for b, c in byte_letters().items()}
        self._normalises = bool(spec.get("normalizer"))
        self.drops_space = bool(self.word_end)
        self.rules = self._rules(spec)

    @cached_property
    def library(self):
        """The library's tokenizer, loaded for the first text that needs it: it is as large as all the rest."""
        return library_tokenizer(self.path)

    def _rules(self, spec: dict) -> str | None:
        """Which splitting rules the file states, if they are ones that allow cutting texts at spaces: the
        bytes with their spaces, or words without; None for any other file."""
        if any("<" not in t or " " in t for t in self.added) or any(t.get(k) for t in spec.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip")):
            return None
        split, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if normal is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not self.word_end:
            return "bytes"
        steps = [(x["type"], x.get("pattern"), x.get("content")) for x in (normal or {}).get("normalizers", ())]
        parts = [(x["type"], x.get("pattern"), x.get("behavior"), x.get("invert"), x.get("use_regex"), x.get("add_prefix_space")) for x in split.get("pretokenizers", ())]
        if steps == _WORD_STEPS and parts == _WORD_PARTS and self.word_end:
            return "words"
        return None

    def letters(self, text: str) -> str:
        """The bytes of a text as byte letters."""
        return text.encode("utf-8").decode("latin-1").translate(self._letters)

    def plain(self, unit: str) -> list[str] | None:
        """The pre-tokens of a unit of letters, common marks and single inner newlines, by one match; None
        for any other unit.  For a vocabulary that normalises, in their normal form."""
        if self.rules is None:
            return None
        if self._normalises:
            found = _PLAIN_WORDS.findall(unit)
            return [f.lower() for f in found if f[0] not in " \n"] if sum(map(len, found)) == len(unit) else None
        found = _PLAIN.findall(unit)
        return found if sum(map(len, found)) == len(unit) and unit[-1:] != "\n" and "\n\n" not in unit else None

    def pieces(self, unit: str):
        """(added token, None) or (None, pre-token in byte letters), in text order."""
        if (found := self.plain(unit)) is not None:
            for part in found:
                yield None, self.letters(part)
            return
        parts = self._added.split(unit) if self._added and "<" in unit else (unit,)
        for part in parts:
            if not part:
                continue
            if part in self.added:
                yield part, None
                continue
            if self._normalises:
                part = self.library.normalizer.normalize_str(part)
            for letters, _ in self.library.pre_tokenizer.pre_tokenize_str(part):
                yield None, letters

    def symbols(self, pre_token: str) -> list[str]:
        """The initial symbols of a pre-token, one for each byte; the last has the word-end mark."""
        out = list(pre_token)
        if out and self.word_end:
            out[-1] += self.word_end
        return out


@worker_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def units(text: str) -> tuple[str, list[str]]:
    """(first, rest): the text is ``first`` followed by the rest, each with one space before it.
    A text with a space after other white space is cut at other places, see ``loose_units``."""
    first, *rest = text.split(" ")
    return first, rest


def is_loose(text: str) -> bool:
    """Whether white space precedes a space somewhere, so that ``units`` could cut a pre-token."""
    return _SPACE_AFTER_SPACE.search(text) is not None


def loose_units(text: str) -> list[str]:
    """Pieces that start with a run of spaces (but for the first); joined they are the text."""
    return _CUT.split(text)


def text_chunks(texts, size: int = 1 << 24):
    """Slices of an Arrow array of texts with at most ``size`` bytes each, or one longer text."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield texts.slice(at, to - at)
        at = to


def distinct_units(texts):
    """(names, extra, codes, bounds) of an Arrow array of texts: text k is the units numbered
    ``codes[bounds[k]:bounds[k + 1]]``, joined.  Units are ``names``, each after one space, and from
    ``len(names)`` on ``extra`` as they are.  Null and empty texts have one empty unit."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    cut = pc.split_pattern(texts, " ")
    bounds, coded = cut.offsets.to_numpy().astype(np.int64), cut.values.dictionary_encode()
    names, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    # white space before a space, inside a text: that text is cut at other places
    spaced = pc.or_(pc.equal(names, ""), pc.utf8_is_space(pc.utf8_slice_codeunits(names, -1))).to_numpy(zero_copy_only=False)[codes]
    spaced[bounds[1:] - 1] = False
    sums = np.concatenate([[0], np.cumsum(spaced)])[bounds]
    loose = np.flatnonzero(sums[1:] > sums[:-1])
    first, number = np.unique(codes[bounds[:-1]], return_inverse=True)
    codes[bounds[:-1]] = len(names) + number
    extra = names.take(pa.array(first)).to_pylist()
    if not len(loose):
        return names, extra, codes, bounds
    own = {k: loose_units(texts[k].as_py()) for k in loose.tolist()}
    place = {u: i for i, u in enumerate(dict.fromkeys(u for some in own.values() for u in some), len(names) + len(extra))}
    rows = [np.asarray([place[u] for u in own[k]]) if k in own else codes[bounds[k] : bounds[k + 1]] for k in range(len(texts))]
    return names, extra + list(place), np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
