"""Whitening of embeddings: exact sums, distributed centred covariance, leading components, broadcast projection."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.llm.symmetric import EPS, leading
from demandlens.session import ship

#: Entries become ``floor(SCALE * entry) + SHIFT``.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Entries count as no larger than this, so that they fit a long.
LARGEST = float(1 << 52)
LONG = 1 << 63


def whole_numbers(vector: Column) -> Column:
    """The entries of a vector as whole numbers."""
    bounded = F.transform(vector, lambda c: F.greatest(F.least(c, F.lit(LARGEST)), F.lit(-LARGEST)))
    return F.transform(bounded, lambda c: F.floor(c * SCALE) + SHIFT)


def usable(vector: Column) -> Column:
    """Whether there is a vector all of whose entries are finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(finite & (F.size(vector) > 0), F.lit(False))


def moved(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exactly: as longs, or as Python's numbers where longs could overflow."""
    if len(x) and n * int(np.abs(x).max()) + max(map(abs, sums)) >= LONG // 2:
        return x.astype(object) * n - np.array(sums, object)
    return x * np.int64(n) - np.array(sums, np.int64)


def deviations(y: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exactly; None where it fits no long."""
    if y.dtype == object or not len(y) or int(np.abs(y).max()) ** 2 * y.shape[1] >= LONG:
        sums = [sum(int(v) ** 2 for v in row) for row in y]
        return [s if s < LONG else None for s in sums]
    return (y * y).sum(1).tolist()


def _summed(rows: DataFrame, products) -> dict[tuple[int, int], float]:
    """Sums over all rows of ``products``, which maps an array of vectors to a matrix, as the upper triangle.

    A task adds up its own rows and sends one number for each cell, which Spark adds up; as many reach the driver as a
    matrix has cells.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                found = products(np.stack(batch["_x"].to_numpy()))
                total = found if total is None else total + found
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    cells = rows.select("_x").mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    return {(r.i, r.j): r.v for r in cells.collect()}


def _matrix(cells: dict[tuple[int, int], float], size: int) -> np.ndarray:
    out = np.zeros((size, size))
    for (i, j), v in cells.items():
        out[i, j] = out[j, i] = v
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """Rows ``id, component, n, deviation, whitened, explained, identity_error`` of every vector and leading component.

    Entries become whole numbers (`whole_numbers`).  ``n`` is how many vectors there are; ``deviation`` is the exact squared
    distance from the mean times ``n`` squared (null if it fits no long); ``whitened`` is the vector less the mean,
    projected on the component (a unit eigenvector of the covariance, by falling eigenvalue), over the root of the
    eigenvalue; ``explained`` is the eigenvalue's share of the trace; ``identity_error`` is how far the covariance of all whitened
    rows, measured over them, is from the identity.

    Vectors that are null or empty, or hold a null or an entry that is not finite, are left out, and so are vectors of another length
    than most have (of several such lengths the greatest counts).  Null and repeated ids and repeated rows are vectors like any other.
    Components without variance have no rows, so one vector, equal vectors and an empty table give none.  Other columns
    are left out.

    The table is read once for each of lengths and sums, covariance, check and result; nothing but cells of a square matrix
    of a vector's size is shuffled, broadcast or sent to the driver, and a lost task repeats its own rows.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    rows = rows.filter(usable(F.col("_v"))).select("_id", whole_numbers(F.col("_v")).alias("_x"))
    id_type = dict(rows.dtypes)["_id"]

    def sizes_and_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch["_x"].map(len)
            for size in lengths.unique():
                own = np.stack(batch["_x"][lengths == size].to_numpy())
                wide = own.astype(object) if np.abs(own).max() >= LONG // max(1, len(own)) // 2 else own
                sums = [str(s) for s in wide.sum(0)]
                yield pd.DataFrame({"size": size, "place": range(-1, size), "sum": [str(len(own)), *sums]})

    added = rows.select("_x").mapInPandas(sizes_and_sums, "size int, place int, sum string")
    added = added.groupBy("size", "place").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
    counted = {(r.size, r.place): int(r.sum) for r in added.collect()}
    schema = f"{id_col} {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    size = max((s for s, place in counted if place < 0), key=lambda s: (counted[s, -1], s), default=0)
    if not size:
        return vectors.sparkSession.createDataFrame([], schema)
    n, sums = counted[size, -1], [counted[size, i] for i in range(size)]
    rows = rows.filter(F.size("_x") == size)

    def centred(x: np.ndarray) -> np.ndarray:
        return (moved(x, n, sums) / n).astype(np.float64)

    covariance = _matrix(_summed(rows, lambda x: (z := centred(x)).T @ z), size) / n
    values, axes = leading(covariance, components)
    trace = float(np.trace(covariance))
    held = values > EPS * size * trace
    values, axes = values[held], axes[:, held]
    if not len(values):
        return vectors.sparkSession.createDataFrame([], schema)
    projection = vectors.sparkSession.sparkContext.broadcast(axes / np.sqrt(values))

    # The mean of whitened rows is that of centred ones, so zero: they are centred as they are.
    spread = _summed(rows, lambda x: (w := centred(x) @ projection.value).T @ w)
    error = float(np.abs(_matrix(spread, len(values)) / n - np.eye(len(values))).max())

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                y = moved(np.stack(batch["_x"].to_numpy()), n, sums)
                found = (y / n).astype(np.float64) @ projection.value
                far = pd.array(deviations(y), "Int64")
                yield pd.DataFrame({"_id": batch["_id"], "deviation": far, "_whitened": list(found)})

    shares = F.array(*[F.lit(float(v / trace)) for v in values])
    projected = rows.mapInPandas(project, f"_id {id_type}, deviation long, _whitened array<double>")
    told = projected.select("_id", "deviation", F.posexplode("_whitened").alias("_at", "whitened"))
    return told.select(
        F.col("_id").alias(id_col),
        (F.col("_at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("_at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
