"""Every stage of the pipeline on what the stage before kept, against brute force."""

import re

import corpus_pipeline
from conftest import SMALL
from demandlens.llm.common import read_table
from demandlens.llm.queries import QUERIES, STATEMENTS
from llm.test_ngrams import expected as near_expected
from llm.test_packing import check, documents

import pytest
from compare import difference, oracle_connection


def test_stages(spark):
    docs = read_table(spark, SMALL, "documents")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact", "near", "packing"]
    labels = {r.doc_id: r.quality for r in read_table(spark, SMALL, "labels").collect()}

    good = stages["quality"](spark, docs, SMALL).cache()
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == columns
    assert sum(i in kept for i, q in labels.items() if q == 1) > 0.95 * sum(q == 1 for q in labels.values())
    assert sum(i not in kept for i, q in labels.items() if q == 0) > 0.7 * sum(q == 0 for q in labels.values())

    first = stages["exact"](spark, good, SMALL).cache()
    by_text = {}
    for r in good.orderBy("doc_id").collect():
        by_text.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert first.columns == columns and {r.doc_id for r in first.collect()} == set(by_text.values())

    apart = stages["near"](spark, first, SMALL).cache()
    rows = [(r.doc_id, r.text) for r in first.collect()]
    assert apart.columns == columns
    assert {r.doc_id for r in apart.collect()} == {c for _, _, c in near_expected(rows, 5, 80, 100)}

    packed = stages["packing"](spark, apart, SMALL).collect()
    want = documents([(r.doc_id, r.text) for r in apart.collect()], 1024)
    assert sorted(((r.doc_id, r.piece, r.start, r["length"], r.ids_crc32) for r in packed), key=repr) == want
    assert check(packed, 1024) <= -(-sum(r["length"] for r in packed) // 1024) + 2


def test_odd_documents(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SMALL)
            assert docs.columns == odd_docs.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
        assert packed.select("doc_id", "piece").distinct().count() <= packed.count()


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_query_matches_sql(spark, name):
    assert difference(QUERIES[name](spark, SMALL), oracle_connection(SMALL), STATEMENTS[name]) is None
