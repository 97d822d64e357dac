"""The registered queries themselves, over the smaller given tables."""

from pathlib import Path

import pytest

from lithos.llm.queries import queries

SMALL, TEN = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
needs = pytest.mark.skipif(not Path(TEN).exists(), reason="needs the given tables")


@needs
def test_ctw_query_beats_the_word_unigram_on_held_out_rows(spark):
    got = queries()["op10_ctw"](spark, TEN)
    assert got.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert [f.dataType.simpleString() for f in got.schema[:7]] == ["bigint", "boolean", "bigint", "bigint", "bigint", "double", "double"]
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{TEN}/documents.parquet").count()
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
