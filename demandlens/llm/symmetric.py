"""Leading eigenvalues and eigenvectors of a small symmetric matrix: Householder, Sturm counts, inverse iteration."""

import numpy as np

EPS = np.finfo(np.float64).eps
#: Eigenvalues nearer than this share of the matrix's norm are a cluster, whose vectors are made orthogonal.
CLUSTER = 1e-3


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit vectors of the Householder reflections that lead there."""
    a = np.array(matrix, np.float64)
    mirrors = []
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        scale = np.abs(x).max()
        v = np.zeros(len(a))
        if scale > 0 and np.abs(x[1:]).max() > 0:
            x /= scale
            x[0] += np.copysign(np.linalg.norm(x), x[0])
            v[k + 1 :] = x / np.linalg.norm(x)
            w = a @ v
            w -= (v @ w) * v
            a -= 2 * (np.outer(v, w) + np.outer(w, v))
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of a tridiagonal matrix lie below each of ``at``."""
    least = EPS * EPS + EPS * (np.abs(off).max(initial=0) + np.abs(diagonal).max(initial=0))
    count, pivot = np.zeros(len(at), np.int64), np.ones(len(at))
    for i, d in enumerate(diagonal):
        pivot = d - at - (off[i - 1] ** 2 / pivot if i else 0)
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues of a tridiagonal matrix, falling, by bisection on Sturm counts."""
    n = len(diagonal)
    radius = np.abs(np.append(off, 0)) + np.abs(np.insert(off, 0, 0))
    edge = 2 * EPS * np.abs(diagonal).max() + 4 * EPS * radius.max()
    low, high = np.full(k, (diagonal - radius).min() - edge), np.full(k, (diagonal + radius).max() + edge)
    wanted = n - 1 - np.arange(k)  # as many eigenvalues lie below
    while True:
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all():
            return middle
        below = sturm_counts(diagonal, off, middle) <= wanted
        low, high = np.where(below, middle, low), np.where(below, high, middle)


def _factored(diagonal: np.ndarray, off: np.ndarray, value: float):
    """The shifted tridiagonal matrix as rows of an upper factor of three bands, with the swaps and factors that led there."""
    n = len(diagonal)
    least = EPS * (np.abs(diagonal).max() + np.abs(off).max(initial=0)) or EPS
    upper, steps = np.zeros((n, 3)), []
    row = np.array([diagonal[0] - value, off[0] if n > 1 else 0.0, 0.0])
    for i in range(n - 1):
        below = np.array([off[i], diagonal[i + 1] - value, off[i + 1] if i + 2 < n else 0.0])
        swap = abs(below[0]) > abs(row[0])
        if swap:
            row, below = below, row
        if abs(row[0]) < least:
            row[0] = least
        factor = below[0] / row[0]
        upper[i] = row
        rest = below - factor * row
        row = np.array([rest[1], rest[2], 0.0])
        steps.append((swap, factor))
    if abs(row[0]) < least:
        row[0] = least
    upper[n - 1] = row
    return upper, steps


def _solved(factored, b: np.ndarray) -> np.ndarray:
    upper, steps = factored
    x = b.copy()
    for i, (swap, factor) in enumerate(steps):
        if swap:
            x[i], x[i + 1] = x[i + 1], x[i]
        x[i + 1] -= factor * x[i]
    for i in reversed(range(len(x))):
        tail = x[i + 1 : i + 3]
        x[i] = (x[i] - upper[i, 1 : 1 + len(tail)] @ tail) / upper[i, 0]
        if abs(x[i]) > 1e150:  # only the direction counts
            x /= abs(x[i])
    return x


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds=6) -> np.ndarray:
    """Unit eigenvectors (columns) of a tridiagonal matrix for falling ``values``.

    Vectors of a cluster of near values are made orthogonal to those before them in every round.
    """
    n = len(diagonal)
    rng = np.random.default_rng(0)
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0))
    vectors, begin = np.zeros((n, len(values))), 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            begin = j
        factored = _factored(diagonal, off, value)
        x = rng.standard_normal(n)
        for _ in range(rounds):
            x = _solved(factored, x / np.linalg.norm(x))
            x /= np.linalg.norm(x)
            for _ in range(2):
                x -= vectors[:, begin:j] @ (vectors[:, begin:j].T @ x)
        vectors[:, j] = x / np.linalg.norm(x)
    return vectors


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    The sign of a vector is such that its largest entry is positive.
    """
    diagonal, off, mirrors = tridiagonal(matrix)
    values = leading_values(diagonal, off, min(k, len(diagonal)))
    vectors = inverse_iteration(diagonal, off, values)
    for v in reversed(mirrors):
        vectors -= 2 * np.outer(v, v @ vectors)
    vectors /= np.linalg.norm(vectors, axis=0)
    largest = vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]
    return values, vectors * np.where(largest < 0, -1, 1)
