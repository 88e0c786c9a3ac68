import zlib

import numpy as np

from pyspark.sql import functions as F

from conftest import SMALL
from demandlens.llm import quality
from demandlens.llm.quality import Vote, classify_quality, fit, keep_good, latent_space, terms


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1


def test_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(i, q, 0, "x") for i, q in ((1, 1), (1, 0), (2, 1), (6, 0), (7, 0), (9, 1), (11, None), (None, 1), (3, 5), (77, 0))],
        "doc_id long, quality int, toxic int, text string",
    )
    found = classify_quality(odd_docs, labels).select("doc_id", "text", "held_out", "score", "predicted").collect()
    assert len(found) == odd_docs.count()
    for r in found:
        assert r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert len({r.score for r in found if not r.text}) == 1
    assert classify_quality(no_docs, labels).count() == 0
    assert {r.score for r in classify_quality(odd_docs, labels.limit(0)).collect()} == {0.5}
    kept = keep_good(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.predicted for r in found)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    found = classify_quality(docs, labels).join(labels, "doc_id").filter("held_out").select("predicted", "quality").collect()
    good = [r.predicted == 1 for r in found if r.quality == 1]
    bad = [r.predicted == 0 for r in found if r.quality == 0]
    assert len(found) > 80 and np.mean(good) > 0.97 and np.mean(bad) > 0.85


def test_a_vote_by_hand():
    matrix = np.eye(4, quality.TERMS, dtype=np.float32)
    vote = Vote(matrix, np.array([1, 1, 0, 0]), dimensions=4, neighbours=2, power=1)
    mixed = matrix[:1] * 3 + matrix[2:3]
    cosines = mixed @ matrix.T / np.linalg.norm(mixed)
    near = np.sort(np.argsort(-cosines[0])[:2])
    assert list(near) == [0, 2]
    want = cosines[0, 0] / (cosines[0, 0] + cosines[0, 2])
    assert abs(vote.scores(mixed)[0] - want) < 1e-4 and vote.scores(np.zeros((1, quality.TERMS), np.float32))[0] == 0.5


def test_terms_do_not_depend_on_stretches(monkeypatch):
    text = "Some WORDS words words, 123 é! " * 50
    whole = terms(text)
    monkeypatch.setattr(quality, "STRETCH", 37)
    assert np.allclose(whole, terms(text)) and not terms("").any() and not terms(None).any()


def test_latent_space_spans_the_leading_directions():
    rng = np.random.default_rng(2)
    low = (rng.standard_normal((60, 5)) @ rng.standard_normal((5, 80))).astype(np.float32)
    space = latent_space(low, 5)
    assert np.allclose(low @ space @ space.T, low, atol=1e-2)


def test_repeated_ids_are_learned_from_once_and_alike_in_any_order(spark):
    rows = [(i % 20, f"{'Good plain words in a row' if i % 2 else 'x x x x 99 99 ##'} number {i}") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    votes = [fit(d, labels) for d in (docs.coalesce(1), docs.orderBy(F.desc("text")).repartition(5))]
    assert all(len(v.labels) == 20 for v in votes)
    assert (votes[0].vectors == votes[1].vectors).all() and (votes[0].labels == votes[1].labels).all()
