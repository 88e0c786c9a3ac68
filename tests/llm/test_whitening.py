import numpy as np
import pytest

from conftest import SMALL
from demandlens.llm.queries import QUERIES
from demandlens.llm.symmetric import leading, leading_values, sturm_counts, tridiagonal
from demandlens.llm.whitening import deviations, moved, whiten


@pytest.mark.parametrize("size", [1, 2, 3, 8, 64, 150])
def test_leading_vectors_of_random_matrices(size):
    rng = np.random.default_rng(size)
    a = rng.standard_normal((size, size))
    a = a @ a.T
    values, vectors = leading(a, 32)
    want, axes = np.linalg.eigh(a)
    k = min(size, 32)
    assert np.allclose(values, want[::-1][:k], rtol=1e-12, atol=1e-12 * want[-1])
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * want[-1]
    assert np.abs(np.abs((axes[:, ::-1][:, :k] * vectors).sum(0)) - 1).max() < 1e-9


def test_clusters_ties_and_zeros():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    for spectrum in (np.repeat([5.0, 3.0, 0.0], [10, 20, 10]), 1 + 1e-13 * np.arange(40), np.zeros(40), np.r_[1e8, np.ones(39)]):
        a = (q * spectrum) @ q.T
        a = (a + a.T) / 2
        values, vectors = leading(a, 32)
        assert np.abs(values - np.sort(spectrum)[::-1][:32]).max() <= 1e-13 * max(1, spectrum.max()) * 10
        assert np.abs(vectors.T @ vectors - np.eye(32)).max() < 1e-12
        assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * max(1e-300, spectrum.max())
    values, vectors = leading(np.diag([3.0, 1.0, 2.0]), 3)
    assert np.allclose(values, [3, 2, 1]) and np.allclose(vectors, np.eye(3)[:, [0, 2, 1]])


def test_sturm_counts():
    diagonal, off, _ = tridiagonal(np.cov(np.random.default_rng(3).standard_normal((12, 50))))
    t = np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1)
    want, at = np.linalg.eigvalsh(t), np.linspace(-1, 4, 101)
    assert (sturm_counts(diagonal, off, at) == [(want < x).sum() for x in at]).all()
    assert np.allclose(leading_values(diagonal, off, 12), want[::-1], rtol=1e-13)


def test_exact_whole_numbers():
    x = np.array([[10**15, -(10**15)], [3, 4]])
    y = moved(x, 10**9, [10**12, 5])
    assert y.dtype == object and y.tolist() == [[10**24 - 10**12, -(10**24) - 5], [3 * 10**9 - 10**12, 4 * 10**9 - 5]]
    assert deviations(y) == [None, (3 * 10**9 - 10**12) ** 2 + (4 * 10**9 - 5) ** 2 if (3 * 10**9 - 10**12) ** 2 < 2**63 else None]
    assert deviations(moved(np.array([[1, 2], [3, 4]]), 2, [4, 6])) == [8, 8]
    assert deviations(np.array([[3_037_000_499, 3_037_000_499]])) == [None] and deviations(np.array([[3_037_000_499, 0]])) == [3_037_000_499**2]


def check(rows, vectors, k):
    """Rows of the operator against numpy on the same vectors (pairs of id and entries)."""
    x = np.floor(64 * np.array([v for _, v in vectors], np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    z = (x * n - sums) / n
    values, axes = np.linalg.eigh(z.T @ z / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    assert len(rows) == n * k
    far = ((x * n - sums).astype(object) ** 2).sum(1)
    want = {}
    for (i, _), zi, d in zip(vectors, z, far, strict=True):
        for c in range(k):
            want[i, c + 1] = (d, abs(zi @ axes[:, c]) / np.sqrt(values[c]), values[c] / np.trace(z.T @ z / n))
    for r in rows:
        d, w, e = want[r[0], r.component]
        assert r.n == n and r.deviation == d
        assert abs(abs(r.whitened) - w) < 1e-7 and abs(r.explained - e) < 1e-9
        assert r.identity_error < 1e-9
    by = {c: np.array([r.whitened for r in rows if r.component == c]) for c in range(1, k + 1)}
    assert all(abs((w**2).mean() - 1) < 1e-9 for w in by.values())


def test_query_on_the_small_tables(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    vectors = [(r.vec_id, r.embedding) for r in table if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    check(QUERIES["op13_whitening"](spark, SMALL).collect(), vectors, 32)


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.standard_normal(3).tolist()) for i in range(50)]
    odd = [
        (100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 1.0, 1.0]), (104, [float("inf"), 1.0, 1.0]),
        (105, [1.0, 2.0]), (None, None),
    ]
    schema = "own long, v array<double>, component int, n long, _x string, _id int"
    df = spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in good + odd], schema)
    found = whiten(df, 32, id_col="own", vector_col="v")
    assert found.columns == ["own", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(found.collect(), good, 3)
    assert len(whiten(df, 2, id_col="own", vector_col="v").collect()) == 100
    assert whiten(df.limit(0), id_col="own", vector_col="v").collect() == []
    one = df.filter("own = 1")
    assert whiten(one, id_col="own", vector_col="v").collect() == []
    assert whiten(one.union(one), id_col="own", vector_col="v").collect() == []
    # Repeated rows and null ids are vectors of their own; a direction without variance has no component.
    flat = spark.createDataFrame([(None, [1.0, 5.0]), (1, [2.0, 5.0]), (1, [2.0, 5.0]), (2, [1e300, 5.0])], "vec_id long, embedding array<double>")
    rows = whiten(flat).collect()
    assert len(rows) == 4 and {r.component for r in rows} == {1} and {r.n for r in rows} == {4}
    assert all(r.deviation is None for r in rows) and all(np.isfinite(r.whitened) for r in rows)
