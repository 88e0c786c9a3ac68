"""Picking rows: latest, first, random; and the table profile."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(df: DataFrame, keys, order) -> DataFrame:
    """The row that sorts last by the ``order`` columns, per ``keys`` (or of the whole table if none).

    ``order`` must be unique within a key.  Either way each task first keeps its own best row per
    key, so a key with a third of all rows sends one row per task.
    """
    descending = [F.col(c).desc() for c in order]
    if not keys:
        return df.orderBy(*descending).limit(1)
    window = Window.partitionBy(*keys).orderBy(*descending)
    return df.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def first_row(df: DataFrame, order) -> DataFrame:
    """The first row by the ``order`` columns; each task offers one row."""
    return df.orderBy(*order).limit(1)


def random_row(df: DataFrame, key: str, seed: int) -> DataFrame:
    """One row chosen by a draw that depends on ``seed`` and the unique ``key`` alone, however rows are partitioned."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(1)


def profile(df: DataFrame, order: str) -> DataFrame:
    """``row_count`` and the first row by ``order``, in one pass (partial aggregates, no sort)."""
    first = F.min_by(F.struct(*df.columns), F.col(order)).alias("_first")
    return df.agg(F.count(F.lit(1)).alias("row_count"), first).select("row_count", "_first.*")
