"""The pipeline's stages and the registered queries."""

import __spark_entry__ as entry
import corpus_pipeline
import pytest

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark, docs, tmp_path):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, plain, SMALL)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == plain.columns, name
        out.write.parquet(str(tmp_path / name))
        plain = spark.read.parquet(str(tmp_path / name))
        assert plain.count() > 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_of_nothing(spark, no_docs, name, stage):
    assert stage(spark, no_docs.select("doc_id", "text", "lang", "source", "n_chars"), SMALL).collect() == []


def test_run(spark):
    pieces = corpus_pipeline.run(spark, SMALL)
    assert pieces.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(pieces.columns)


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_query_matches_sql(spark, name):
    import os
    import sys

    sys.path.insert(0, os.path.join(os.path.dirname(corpus_pipeline.__file__), "tools"))
    import check_oracles

    status, note, _ = check_oracles.compare(spark, check_oracles.connect(SMALL), name, SMALL)
    assert status == "OK", note
