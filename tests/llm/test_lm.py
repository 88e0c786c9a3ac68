import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from conftest import SMALL
from demandlens.llm import gru, lm
from demandlens.llm.common import scratch, written
from demandlens.llm.gru import Gru, windows
from demandlens.llm.lm import score


def expected(rows):
    """What does not depend on the network."""
    tokens = [(i, (t or "").encode().lower().split() + [b""], zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2) for i, t in rows]
    counts = Counter(w for _, words, held in tokens if not held for w in words)
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, words, held in tokens:
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        out.append((i, held, len(words), sum(counts[w] > 0 for w in words), n, round(base, 5)))
    return sorted(out, key=repr)


def told(df):
    return sorted(((r[0], *r[1:5], round(r.base_score, 5)) for r in df.collect()), key=repr)


def test_odd_documents(odd_docs, no_docs):
    found = score(odd_docs)
    assert told(found) == expected([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert all(math.isfinite(r.score) and r.score <= 0 for r in found.collect())
    assert score(no_docs).count() == 0


def test_nothing_to_learn_from(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    docs = spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")
    assert {(r.train_tokens, r.base_score, r.score) for r in score(docs).collect()} == {(0, 0.0, 0.0)}


def test_the_network_beats_the_base_on_held_out_documents(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 30_000)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = score(docs, parts=3)
    assert told(found) == expected([(r.doc_id, r.text) for r in docs.collect()])
    held = [r for r in found.collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("ids", [[None], [1, 2, 4], range(100, 400)])
def test_the_network_learns_from_every_training_document(spark, ids):
    """Hot, null and spread ids alike: no id is left out of training for its hash."""
    outside = spark.createDataFrame([(i,) for i in ids], "doc_id long").filter("doc_id is null or pmod(xxhash64(string(doc_id)), 16) > 1")
    keys = [r.doc_id for r in outside.collect() if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 != 2]
    rows = [(keys[n % len(keys)], "left right " * 20 + f"own{n}") for n in range(300)]
    found = score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.score for r in found) > 0.95 * sum(r.base_score for r in found)


def test_words_beyond_the_known_ones_are_told_apart(spark):
    rows = [(n, "left right " * 20 + f"own{n}") for n in range(300)]
    found = score(spark.createDataFrame(rows, "doc_id long, text string"), words=1).collect()
    assert sum(r.score for r in found) > 0.95 * sum(r.base_score for r in found)


def test_classes_of_other_words_sum_to_one_and_start_at_their_shares():
    others = np.array([1, 2, 3]) / 18
    model = Gru(np.log(np.full(12, 1 / 18)), np.log(others), units=5, classes=3)
    each = [math.exp(model.log_probability(np.zeros((1, 5)), np.array([w]))[0]) for w in range(15)]
    assert np.allclose(each, [1 / 18] * 12 + [*others], atol=1e-6)


def _model(seed=1):
    model, rng = Gru(np.log(np.full(12, 1 / 14)), np.log(2 / 14), units=5, classes=3, seed=seed), np.random.default_rng(seed)
    for k, v in model.p.items():
        model.p[k] = v.astype(np.float64) + 0.2 * rng.standard_normal(v.shape) * (v > -20)
    return model


def test_probabilities_sum_to_one():
    model = _model()
    states = np.random.default_rng(0).standard_normal((3, 5))
    for s in states:
        total = sum(math.exp(model.log_probability(s[None], np.array([w]))[0]) for w in range(13))
        assert abs(total - 1) < 1e-6


def test_gradients_are_those_of_the_likelihood():
    model, rng = _model(), np.random.default_rng(0)
    tokens, state = rng.integers(0, 13, (6, 4)), rng.standard_normal((4, 5))

    def likelihood():
        states, _, _ = model.forward(tokens, state)
        return model.log_probability(states.reshape(-1, 5).astype(np.float64), tokens.ravel()).sum()

    _, grads, _ = model.gradients(tokens, np.ones_like(tokens, bool), state)
    for name, value in model.p.items():
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in value.shape)
            old, e = value[at], 1e-3
            value[at] = old + e
            up = likelihood()
            value[at] = old - e
            down = likelihood()
            value[at] = old
            assert grads[name][at] == pytest.approx((up - down) / (2 * e), abs=1e-2, rel=1e-2)


def test_windows_and_lanes_do_not_change_a_score():
    model, rng = _model(), np.random.default_rng(9)
    documents = [np.append(rng.integers(1, 13, n), 0) for n in (0, 1, 5, 40, 3, 200, 17)]
    alone = np.array([model.score([d], window=1000, lanes=1)[0] for d in documents])
    for window, lanes in ((1, 1), (3, 2), (16, 4), (7, 50)):
        assert np.allclose(model.score(documents, window, lanes), alone, rtol=1e-4)
    assert sum(int(live.sum()) for _, live in windows(documents, 4, 3)) == sum(map(len, documents))


def test_a_cut_segment_begins_without_a_state():
    """Training on segments end to end in a lane gives the gradients of each segment by itself."""
    rng = np.random.default_rng(3)
    model = Gru(np.log(np.full(6, 1 / 7)), np.log(1 / 7), units=3, classes=2)
    for v in model.p.values():
        v += rng.standard_normal(v.shape).astype(np.float32) * 0.3
    cut, rest = rng.integers(1, 6, 5), np.append(rng.integers(1, 6, 4), 0)
    ((tokens, live, fresh),) = windows([cut, rest], window=10, lanes=1, starts=True)
    assert tokens.shape == (10, 1) and fresh[:, 0].tolist() == [i in (0, 5) for i in range(10)]
    state = np.zeros((1, 3), np.float32)
    value, grads, _ = model.gradients(tokens, live, state, fresh=fresh)
    alone = [model.gradients(d[:, None], np.ones((len(d), 1), bool), state) for d in (cut, rest)]
    assert abs(value - sum(a[0] for a in alone)) < 1e-4
    for k, g in grads.items():
        assert np.allclose(g, sum(a[1][k] for a in alone), atol=1e-4), k


def test_blocks_and_shifts_do_not_change_probabilities_or_gradients(monkeypatch):
    model, rng = _model(), np.random.default_rng(4)
    tokens, state, weights = rng.integers(0, 13, 60), rng.standard_normal((60, 5)), rng.integers(0, 2, 60).astype(float)
    whole = model.log_probability(state, tokens, weights)
    for rows, safe in ((7, 60), (1, 60), (1024, -1), (7, -1)):
        monkeypatch.setattr(gru, "ROWS", rows)
        monkeypatch.setattr(gru, "SAFE", safe)
        found = model.log_probability(state, tokens, weights)
        assert np.allclose(found[0], whole[0]) and np.allclose(found[2], whole[2])
        assert all(np.allclose(found[1][k], whole[1][k]) for k in ("top", "class", "word"))


def test_very_large_weights_give_finite_probabilities():
    model = _model()
    for k in ("top", "class", "word"):
        model.p[k] = model.p[k] * 1e4
    assert np.isfinite(model.log_probability(np.ones((13, 5)), np.arange(13))).all()


def test_rare_classes_share_calls_and_say_the_same(monkeypatch):
    """A batch over many classes takes a few calls, with the probabilities and gradients of one call for each class."""
    rng = np.random.default_rng(6)
    model = Gru(np.log(np.full(480, 1 / 500)), np.log(np.full(3, 1 / 500)), units=5, classes=48)
    for k, v in model.p.items():
        model.p[k] = v.astype(np.float64) + 0.2 * rng.standard_normal(v.shape) * (v > -20)
    tokens, state, weights = rng.integers(0, 483, 300), rng.standard_normal((300, 5)), rng.integers(0, 2, 300).astype(float)
    calls, blocks = [], gru._blocks
    monkeypatch.setattr(gru, "_blocks", lambda *a: (calls.append(len(p)) or p for p in blocks(*a)))
    found = model.log_probability(state, tokens, weights)
    shared = sum(calls)
    for joined, few, rows in ((1, 48, 1024), (8, 0, 1024), (5, 48, 64), (48, 48, 7)):
        calls.clear()
        for name, value in (("JOINED", joined), ("FEW", few), ("ROWS", rows)):
            monkeypatch.setattr(gru, name, value)
        alone = model.log_probability(state, tokens, weights)
        assert np.allclose(found[0], alone[0]) and np.allclose(found[2], alone[2])
        assert all(np.allclose(found[1][k], alone[1][k]) for k in ("top", "class", "word"))
        assert few and joined == 5 or sum(calls) > 2 * shared


def test_steps_are_those_of_adam():
    rng = np.random.default_rng(2)
    value, one, two = np.zeros(5), np.zeros(5), np.zeros(5)
    plain, first, second = np.zeros(5), np.zeros(5), np.zeros(5)
    for done in range(1, 30):
        g = rng.standard_normal(5)
        first, second = 0.9 * first + 0.1 * (g / 3), 0.999 * second + 0.001 * (g / 3) ** 2
        plain += 0.02 * (first / (1 - 0.9**done)) / (np.sqrt(second / (1 - 0.999**done)) + 1e-8)
        gru._adam(value, one, two, g.copy(), 1 / 3, 0.02, done)
        assert np.allclose(value, plain)


def test_rows_are_summed_by_their_number():
    rng = np.random.default_rng(8)
    rows, values = np.append(rng.integers(0, 40, 200), [50] * 30), rng.standard_normal((230, 3))
    found, sums = gru._summed(gru._short(rows, 51), values)
    assert found.tolist() == sorted(set(rows.tolist()))
    assert np.allclose(sums, [values[rows == r].sum(0) for r in found])
    assert gru._short(rows, 1 << 17) is rows


def test_chunks_hold_every_word_in_order(spark, monkeypatch):
    """Numbers of words stand for the words that Python parts by ASCII white space; chunks close at their size."""
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 12)
    texts = [None, "", " ", "a\x0bB\x0cc\x1cd\x1f e f\u0130X", "\t x  y \r\n", "\x85 z\x85", "one Two two " * 9, "x", "y a"]
    rows = [(str(i), t, i % 3 == 0, i % 4) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "_id string, _text string, _held boolean, _part int").coalesce(1)
    told = lm.numbered_words(docs).orderBy("chunk").collect()
    found = []
    for row in told:
        words, tokens = row.words.split(" "), np.frombuffer(row.tokens, "<u4")
        assert len(set(words)) == len(words) and sum(row.sizes[:-1]) < 12
        own = np.repeat(~np.array(row.held), row.sizes)
        assert np.frombuffer(row["counts"], "<i8").tolist() == np.bincount(tokens[own], minlength=len(words)).tolist()
        cut = np.split(tokens, np.cumsum(row.sizes)[:-1])
        found += [(i, [words[n].encode() for n in t], h, p) for i, t, h, p in zip(row.ids, cut, row.held, row.part, strict=True)]
    assert len(told) > 2
    assert found == [(i, (t or "").encode().lower().split() + [b""], h, p) for i, t, h, p in rows]


class _Frame:
    """Gives the function that a frame would run in its tasks."""

    def mapInArrow(self, run, schema):
        return run


def test_an_open_chunk_keeps_numbers_and_no_texts(monkeypatch):
    """What a task holds between batches is far below the texts that it has read for the chunk."""

    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():
            return 0

    monkeypatch.setattr(lm, "TaskContext", Task)
    held, start = [], pa.total_allocated_bytes()

    def batches():
        for n in range(20):
            text = " ".join(f"{i:04d}" + "word" * 15 for i in range(500)) + " "
            rows = {"_id": [f"{n}"], "_text": [text * 30], "_held": [False], "_part": pa.array([0], pa.int32())}
            # As read from Spark: one buffer behind all columns of a batch.
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, (batch := pa.RecordBatch.from_pydict(rows)).schema) as out:
                out.write_batch(batch)
            del rows, batch
            yield pa.ipc.open_stream(sink.getvalue()).read_next_batch()
            del sink
            held.append(pa.total_allocated_bytes() - start)

    (chunk,) = lm.numbered_words(_Frame())(batches())
    assert len(chunk["sizes"][0]) == 20 and chunk["sizes"][0][0].as_py() == 15_001
    # Twenty texts of almost a megabyte.
    assert max(held) < 6 << 20


def test_texts_are_taken_apart_a_few_bytes_at_a_time():
    batch = pa.RecordBatch.from_pydict({"t": ["a" * n for n in (3, 3, 9, 0, 1)] + [None, "bb"]})
    slices = [b["t"].to_pylist() for b in lm._bounded(iter([batch, batch.slice(0, 0)]), "t", 6)]
    assert sum(slices, []) == batch["t"].to_pylist() and len(slices) == 4
    assert all(sum(len(t or "") for t in s[1:]) <= 6 for s in slices)


def test_row_groups_of_large_rows_are_small(spark):
    rows = spark.range(0, 12, 1, 1).selectExpr("id", "array_join(transform(sequence(1, 60000), x -> uuid()), '') AS t")
    folder = scratch(spark, "short-groups")
    assert written(rows, "short-groups", "zstd", folder, **lm.SHORT_GROUPS).selectExpr("count(t)").first()[0] == 12
    (meta,) = [f.metadata for f in pq.ParquetDataset(folder.removeprefix("file://")).fragments]
    assert meta.num_row_groups >= 6
