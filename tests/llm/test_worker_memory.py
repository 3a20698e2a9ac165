"""What Python workers hold, which live on from stage to stage."""

import tracemalloc
import weakref

import numpy as np
import psutil
import pyarrow as pa
from pyspark.sql import types as T

from larkspur.llm.bpe import vocabulary, vocabulary_path
from larkspur.llm.bpe_codec import Codec, codec
from larkspur.llm.common import let_go
from larkspur.llm.toxicity import Model


def test_codec_remembers_words_in_few_bytes():
    own = Codec(vocabulary(vocabulary_path("word_bpe_49k.json")))
    words = ["".join(chr(97 + n // 26**k % 26) for k in range(8)) for n in range(0, 26**6, 26**6 // 10_000)]
    tracemalloc.start()
    try:
        list(own.all_encoded(words))
        held = tracemalloc.get_traced_memory()[0] / len(own.words)
    finally:
        tracemalloc.stop()
    assert held < 250  # it was 370 with the decoded text beside the identifiers


def test_a_worker_lets_go_of_what_other_operators_kept():
    class Rows:
        columns, schema = ["text"], T.StructType([T.StructField("text", T.StringType())])
        mapInArrow = staticmethod(lambda run, schema: run)  # noqa: N815

    kept = weakref.ref(codec(vocabulary_path("word_bpe_49k.json")))
    assert kept() and codec.cache_info().currsize
    score = Model({}, 0.0).score(Rows())
    assert [b.column(1).to_pylist() for b in score([pa.record_batch([pa.array(["a", None])], ["text"])])] == [[0.5, 0.5]]
    assert not codec.cache_info().currsize and kept() is None


def test_freed_memory_goes_back_to_the_system():
    """What large batches of one stage took and freed is not held through the next ones."""
    held = lambda: psutil.Process().memory_info().rss >> 20
    blocks = [np.ones(12_000) for _ in range(2_500)]  # too small to be mapped one by one
    last, before = blocks[-1], held()
    del blocks
    let_go()
    assert before - held() > 150 and last.sum() == 12_000
