"""Registered queries of the subpackage against their SQL, and the pipeline's stages in turn."""

import __spark_entry__ as spark_entry
import corpus_pipeline
import pytest
from compare import connect, differences


@pytest.mark.parametrize("name", list(spark_entry.CORPUS_SQL))
def test_same_as_sql(spark, sf_dir, name):
    assert differences(spark_entry.queries()[name](spark, sf_dir), connect(sf_dir), spark_entry.CORPUS_SQL[name]) is None


def test_one_query_per_operator():
    assert {int(n[2:].split("_")[0]) for n in spark_entry.CORPUS_QUERIES if n.startswith("op")} == set(range(1, 14))
    assert "pipeline" in spark_entry.queries()


def test_pipeline_is_its_stages(spark, sf_dir, documents):
    docs = documents
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, sf_dir)
        assert k == 4 or docs.columns == documents.columns
        after = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert len(after) == len(set(after)) and set(after) <= before
        assert len(after) == len(before) if k == 4 else len(after) > 0.6 * len(before)
    have = sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))
    assert have == sorted(map(tuple, docs.collect()))


def test_stages_take_odd_and_empty_documents(spark, sf_dir, odd, documents):
    odd = odd.select(*documents.columns)
    for stage in (odd, odd.limit(0)):
        for name, function in corpus_pipeline.STAGES:
            stage = function(spark, stage, sf_dir)
        rows = stage.collect()
    assert rows == [] and name.startswith("BPE")


def test_near_duplicate_stage_keeps_one_of_repeated_rows(spark, sf_dir, odd, documents):
    kept = corpus_pipeline.near_duplicates(spark, odd.select(*documents.columns), sf_dir)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8]


def test_near_duplicate_stage_judges_rows_not_ids(spark, sf_dir):
    a, b, c = ("one two three four five six seven", "p q r s t u v w", "else entirely and not like any of them")
    rows = [(2, a), (2, b), (1, a), (1, a), (None, b), (None, c), (3, c), (4, ""), (5, None), (6, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string")
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, a), (2, b), (3, c), (4, ""), (5, None), (6, "")], key=str)
