from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from cohortica.llm.common import kept

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")


@needs_data
def test_all_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


@needs_data
def test_stages_keep_the_columns(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = kept(stage(spark, docs, SF), name)
            assert docs.columns == odd_docs.columns, name
        out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
        out.collect()


@needs_data
def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and max(r["offset"] + r["length"] for r in rows) <= 2048
