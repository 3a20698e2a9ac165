from hashlib import sha256

import pytest
from test_jaccard_join import brute as brute_components
from test_line_dedup import brute as brute_lines
from test_text_rules import brute_contamination
from tokenizers import Tokenizer

import corpus_pipeline as cp
from larkspur.llm.bpe import vocabulary_path
from larkspur.llm.common import table
from larkspur.llm.decontaminate import cut_spans, words
from larkspur.llm.toxicity import toxicity_scores

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(documents, rows after each stage), each stage on its predecessor's rows."""
    docs, out = table(spark, SF, "documents"), []
    out.append((None, docs.collect()))
    for name, stage in cp.STAGES:
        made = stage(spark, docs, SF)
        rows = made.collect()
        if name != "bpe_codec":
            assert made.columns == docs.columns and made.dtypes == docs.dtypes
            docs = spark.createDataFrame(rows, docs.schema)
        out.append((name, rows))
    return out


def test_toxicity_stage(spark, stages):
    scores = {r.doc_id: r.predicted for r in toxicity_scores(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()}
    assert sorted(stages[1][1]) == sorted(r for r in stages[0][1] if not scores[r.doc_id])


def test_line_stage(stages):
    rows = sorted(stages[1][1])
    want = brute_lines([(r.doc_id, r.text) for r in rows], 8)
    assert [(r.doc_id, r.text, r.n_chars) for r in sorted(stages[2][1])] == [(r.doc_id, t, len(t)) for r, t in zip(rows, want, strict=True)]


def test_jaccard_stage(stages):
    keep = {d for d, _, c in brute_components([(r.doc_id, r.text) for r in stages[2][1]], 5, 80) if d == c}
    assert sorted(stages[3][1]) == sorted(r for r in stages[2][1] if r.doc_id in keep)


def test_decontamination_stage(spark, stages):
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    got = {r.doc_id: r for r in stages[4][1]}
    for r in stages[3][1]:
        n, hit, *_ = brute_contamination(r.text, items, 10)
        if not hit:
            assert got.pop(r.doc_id) == r
        elif 2 * hit > n:
            assert r.doc_id not in got
        else:
            left = got.pop(r.doc_id)
            assert len(words(left.text)) == n - hit and left.n_chars == len(left.text)
    assert not got


def test_last_stage_and_run(spark, stages):
    library = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in stages[4][1]}
    for r in stages[5][1]:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert sorted(cp.run(spark, SF).collect()) == sorted(stages[5][1])


def test_cut_keeps_the_rest():
    assert cut_spans("a b c d", [(0, 1), (2, 4)]) == " b "


def test_emptied_documents_go(spark, stages):
    word = lambda r: bool((r.text or "").strip(" \t\r\n\f\v"))
    had = {r.doc_id for r in stages[0][1] if word(r)}
    want = {r.doc_id for r in stages[4][1] if word(r) or r.doc_id not in had}
    assert sorted(r.doc_id for r in stages[5][1]) == sorted(want) and len(want) < len(stages[4][1])
    before = spark.createDataFrame([(1, "a"), (2, "a"), (3, " \n"), (4, None), (None, "b")], "doc_id long, text string")
    after = spark.createDataFrame([(1, "a"), (2, ""), (3, " \n"), (4, None), (None, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in cp.without_emptied(after, before).collect()) == [1, 3, 4]
