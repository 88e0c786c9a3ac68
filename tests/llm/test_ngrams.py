import random

import numpy as np
import pytest

from demandlens.llm import ngrams
from demandlens.llm.ngrams import keep_smallest, near_sets, open_groups


def shingles(text, words):
    parts = (text or "").encode().lower().split()
    k = min(words, len(parts))
    return {tuple(parts[i : i + k]) for i in range(len(parts) - k + 1)} if parts else set()


def expected(rows, words, num, den):
    """All pairs compared; rows that share an id are one node."""
    sets = [(i, shingles(t, words)) for i, t in rows]
    top = {i: i for i, _ in rows if i is not None}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    links = [0] * len(sets)
    for k, (i, a) in enumerate(sets):
        for m, (j, b) in enumerate(sets[k + 1 :], k + 1):
            if i is not None and j is not None and a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((find(i), find(j)))
                top[y] = x
                links[k] += 1
                links[m] += 1
    return sorted(((i, len(s), None if i is None else find(i), links[k]) for k, (i, s) in enumerate(sets)), key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_odd_documents(odd_docs, no_docs):
    want = expected([(r.doc_id, r.text) for r in odd_docs.collect()], 4, 85, 100)
    assert rows(near_sets(odd_docs)) == want
    assert rows(near_sets(no_docs)) == []
    kept = keep_smallest(odd_docs)
    assert kept.columns == odd_docs.columns and keep_smallest(no_docs).count() == 0
    assert {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 6, 8, 9, 10, 11, None}


@pytest.mark.parametrize("words, num, members", [(4, 85, 256), (5, 80, 3)])
def test_families_of_near_copies(spark, monkeypatch, words, num, members):
    """Copies with few and many edits, shared passages, and chains; with groups split into parts of three, too."""
    monkeypatch.setattr(ngrams, "MEMBERS", members)
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=40)
    texts = []
    for family in range(12):
        base = rng.choices(vocabulary, k=rng.randint(5, 150)) + (passage if family % 3 == 0 else [])
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy
            if rng.random() < 0.2:
                texts.append(" ".join(copy))
    data = list(enumerate(texts, 1))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    want = expected(data, words, num, 100)
    assert len({c for _, _, c, _ in want}) < len(data)
    assert rows(near_sets(docs, words, num, 100)) == want


def test_open_groups_counts_in_blocks(monkeypatch):
    monkeypatch.setattr(ngrams, "CELLS", 8)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 50)).astype(np.uint64) for _ in range(9)]
    ids = list(range(9))
    near = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 40 * len(np.union1d(a, b))
    want = {(i, j) for i in ids for j in ids if i < j and near(sets[i], sets[j])}
    assert want and set(open_groups((ids, sets), None, 40, 100)) == want
    across = {(i, j) for i, j in want if i < 4 <= j}
    assert set(open_groups((ids[:4], sets[:4]), (ids[4:], sets[4:]), 40, 100)) == across
