"""Counts in flat token files equal those of the encoder, whatever the blocks cut through."""

import public_tokenizers
import pytest

from faultgauge.llm import bpe, separators

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 16])
def test_counts(spark, block):
    rows = [(1, "one two three"), (2, None), (3, ""), (4, "word " * 60), (4, "word " * 60), (None, "x"), (5, "é" * 40)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, ids string").repartition(2)
    got = separators.document_counts(docs, PATH, public_tokenizers.PATTERN, block).collect()
    want = bpe.encode(docs, PATH, public_tokenizers.PATTERN).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=repr) == sorted(((r.doc_id, r.n_tokens) for r in want), key=repr)
    assert separators.document_counts(docs.filter("doc_id < 0"), PATH, public_tokenizers.PATTERN).collect() == []
