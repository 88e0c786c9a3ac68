import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from demandlens.llm import runs
from demandlens.llm.queries import QUERIES
from demandlens.llm.runs import collapse_runs, find_runs, longest_run, with_planted_runs


def brute(words, min_length=12):
    """All maximal stretches by their smallest period, straight from the definition."""
    out, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_length, 2 * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in out.items())


def by_start(found):
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("min_length", [1, 2, 5, 12, 40])
def test_runs_are_those_of_brute_force(min_length):
    rng = random.Random(min_length)
    for case in range(250):
        words = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(0, 160))]
        for _ in range(rng.randrange(3)):
            at, p = rng.randrange(len(words) + 1), rng.randrange(1, 40)
            part = [rng.randrange(3) for _ in range(p)]
            words[at:at] = (part * 6)[: rng.randrange(1, 6 * p + 1)]
        got = list(zip(*(x.tolist() for x in find_runs(np.array(words, np.int64), min_length)), strict=True))
        assert got == by_start(brute(words, min_length)), (case, words)


def test_one_word_repeated_stays_linear():
    words = np.zeros(300_000, np.int64)
    assert [x.tolist() for x in find_runs(words)] == [[0], [300_000], [1]]
    fibonacci = "0"
    last = "1"
    while len(fibonacci) < 30_000:
        fibonacci, last = fibonacci + last, fibonacci
    start, length, period = find_runs(np.frombuffer(fibonacci.encode(), np.uint8).astype(np.int64))
    assert len(start) < len(fibonacci) and (length >= 2 * period).all()


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def rows(df):
    return {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in df.collect()}


def test_odd_documents(odd_docs, no_docs):
    found = collapse_runs(odd_docs)
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    want = []
    for r in odd_docs.collect():
        words = words_of(r.text)
        if len(words) < 1000:
            own = by_start(brute(words))
            want.append((r.doc_id, len(words), own, collapsed(words, own)))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect()]
    assert sorted((g for g in got if g[1] < 1000), key=repr) == sorted(want, key=repr)
    long = [g for g in got if g[1] >= 1000]
    assert [(g[0], g[2]) for g in sorted(long)] == [(6, long_runs(odd_docs, 6)), (7, long_runs(odd_docs, 7))]
    assert collapse_runs(no_docs).collect() == []


def long_runs(docs, doc_id):
    words = words_of(docs.filter(F.col("doc_id") == doc_id).first().text)
    kinds = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.array([kinds[w] for w in words])
    found = {}
    for q in range(1, len(ids) // 2 + 1):
        same = np.concatenate([[False], ids[q:] == ids[:-q], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        for s, e in edges[edges[:, 1] - edges[:, 0] >= max(12 - q, q)]:
            found.setdefault((int(s), int(e) + q), q)
    return by_start((s, e - s, q) for (s, e), q in found.items())


def test_texts_are_searched_apart(spark, monkeypatch):
    """A text that ends as the next begins makes no run across; batches of any size give the same."""
    docs = spark.createDataFrame([(i, "a b c " * 5 + f"x{i}", "no") for i in range(40)], "doc_id long, text string, runs string").coalesce(1)
    want = {i: (16, [(0, 15, 3)], f"a b c x{i}") for i in range(40)}
    assert rows(collapse_runs(docs)) == want
    monkeypatch.setattr(runs, "WORDS", 20)
    assert rows(collapse_runs(docs)) == want


def planted(doc_id, text):
    words, h = words_of(text), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_query_on_the_small_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    assert len(got) == len(docs)
    seen = 0
    for d in docs:
        words, r = planted(d.doc_id, d.text), got[d.doc_id]
        if len(words) > 2500:
            continue
        found = by_start(brute(words))
        seen += len(found)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert r.n_runs == len(found)
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        text = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        assert r.runs_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, found).encode()).hexdigest()
    assert seen > 10


def test_planting_and_the_longest_run(spark):
    cases = [(i, "a b  c\td e f g h i j k l m\n") for i in range(60)] + [(None, "x y z"), (None, None), (7, "")]
    docs = spark.createDataFrame(cases, "doc_id long, text string")
    got = sorted(((r.doc_id, " ".join(words_of(r.text))) for r in with_planted_runs(docs).collect()), key=repr)
    assert got == sorted(((i, " ".join(planted(i, t))) for i, t in cases), key=repr)
    tied = "array(named_struct('start', 5L, 'length', 20L, 'period', 2L), named_struct('start', 1L, 'length', 20L, 'period', 3L))"
    df = spark.sql(f"SELECT {tied} AS runs UNION ALL SELECT slice({tied}, 1, 0)").select(longest_run(F.col("runs")).alias("r"))
    assert {r.r and tuple(r.r) for r in df.collect()} == {(1, 20, 3), None}
