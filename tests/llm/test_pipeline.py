"""The pipeline's stages: columns, effects and the rules between them."""

from __future__ import annotations

import pytest

from docketry.llm import bagminhash, tiling, windows
from docketry.llm.tables import stored, table

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_take_effect(spark, small):
    docs = table(spark, small, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, small))
        counts.append(docs.count())
        assert docs.columns == columns, name
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    assert tiling.leaks(docs, table(spark, small, "benchmark")).count() == 0
    assert windows.repeated_passages(docs).count() <= 2
    assert bagminhash.near_classes(docs).where("doc_id <> class_id").count() <= 2
    last = pipeline.STAGES[-1][1](spark, docs, small)
    assert last.count() == counts[-1] and last.where("rate < 0 OR rate IS NULL").count() == 0
