"""One text of 60,000 words beside short ones, null and empty texts, through operators that look at whole texts."""

import random

import pytest

from larkspur.llm.decontaminate import contamination
from larkspur.llm.jaccard_join import jaccard_components
from larkspur.llm.line_dedup import dedup_lines
from larkspur.llm.repetition import repetition_rules
from larkspur.llm.suffix_dedup import remove_repeats

RND = random.Random(9)
WORDS = ["".join(RND.choice("abcdefghij") for _ in range(RND.randint(3, 9))) for _ in range(60_000)]
#: Lines of twelve words; the last five repeat the first ones.
LINES = [" ".join(WORDS[k : k + 12]) for k in range(0, 60_000, 12)]
LONG = "\n".join([*LINES, *LINES[:5]])


@pytest.fixture(scope="module")
def docs(spark):
    near = "\n".join([*LINES[:-3], *LINES[:5]])
    rows = [(1, LONG), (2, near), (3, LINES[7]), (4, None), (5, ""), (6, "short and clean words that nothing else has at all")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, LINES[7]), (2, "none of these words is anywhere in the long text of this test")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in contamination(docs, items).collect()}
    assert got == {1: (60_060, 12, 1), 2: (60_024, 12, 1), 3: (12, 12, 1), 4: (0, 0, 0), 5: (0, 0, 0), 6: (10, 0, 0)}


def test_repetition(docs):
    got = {r.doc_id: r for r in repetition_rules(docs).collect()}
    assert (got[1].n_words, got[1].n_dup_lines, got[1].n_repeat_words) == (60_060, 5, 120) and got[1].kept and got[4].base_failed


def test_links(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert got[2][1] == 1 and {i: c for i, (_, c) in got.items() if i > 2} == {i: i for i in (3, 4, 5, 6)} and got[1][0] == 60_000


def test_repeats(docs):
    got = {r.doc_id: r for r in remove_repeats(docs).collect()}
    size = len("\n".join(LINES[:5]))
    assert size <= got[1].n_removed <= size + 2 and got[2].n_removed > 0.99 * got[2].n_bytes and got[6].n_removed == got[4].n_removed == 0


def test_lines(docs):
    got = {r.doc_id: r.text for r in dedup_lines(docs).collect()}
    assert got[1].count("\n") == len(LINES) - 1 and not (got[2] or "").strip() and not got[3].strip() and got[4] is None and got[5] == "" and got[6].startswith("short")
