import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from demandlens.llm.exact import exact_dedup, keep_first


def expected(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    out = []
    for norm, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, keep, len(ids), i == keep, sha) for i in ids]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_odd_documents(odd_docs, no_docs):
    want = expected([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert rows(exact_dedup(odd_docs)) == want
    assert rows(exact_dedup(no_docs)) == []


def test_texts_with_one_digest_are_told_apart(odd_docs):
    """The state's key is the same for all: only the texts themselves can tell."""
    want = expected([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert rows(exact_dedup(odd_docs, digest=lambda sha: F.substring(sha, 1, 0))) == want


def test_many_batches_keep_the_smallest_id(spark, tmp_path):
    texts = [(100 - i, f"text {i % 7}") for i in range(100)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(texts, "doc_id long, text string").repartition(10).write.parquet(path)
    assert rows(exact_dedup(spark.read.parquet(path), batch_bytes=1)) == expected(texts)


def test_kept_rows(odd_docs, no_docs):
    kept = keep_first(odd_docs)
    assert kept.columns == odd_docs.columns and keep_first(no_docs).count() == 0
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == [1, 10, 3, 5, 6, 7, 8, 9, 9]
