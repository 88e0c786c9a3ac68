"""Near-duplicate vectors by random-hyperplane sign hashing in several tables, exact cosines and components."""

from math import acos, ceil, log, log2, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import written
from demandlens.llm.components import components
from demandlens.session import ship

THRESHOLD = 0.9
#: The share of pairs just at the threshold that meet in some table; closer pairs meet more often.
RECALL = 0.999
#: Vectors that a bucket has on average, and vectors that are compared at a time.
OCCUPANCY, BLOCK = 256, 512
SEED = 20


def tables_for(vectors: int, threshold=THRESHOLD, recall=RECALL, occupancy=OCCUPANCY) -> tuple[int, int]:
    """Bits of a table and number of tables for so many vectors.

    A bit agrees for a pair at the threshold with chance ``1 - angle / pi``.  Bits grow with the logarithm of the
    vectors, so that buckets stay small; tables follow, so that ``recall`` stays.
    """
    bits = min(48, max(1, ceil(log2(max(2, vectors) / occupancy))))
    meet = (1 - acos(threshold) / pi) ** bits
    return bits, max(1, ceil(log(1 - recall) / log(1 - meet)))


def planes(dims: int, bits: int, tables: int, seed=SEED) -> np.ndarray:
    return np.random.default_rng([seed, dims]).standard_normal((dims, bits * tables))


def signs(vectors: np.ndarray, bits: int, tables: int, seed=SEED) -> np.ndarray:
    """The bucket of each vector in each table: on which side of the table's planes it lies."""
    sides = (vectors @ planes(vectors.shape[1], bits, tables, seed) >= 0).reshape(len(vectors), tables, bits)
    return sides.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one in double precision, whatever the size of their components."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def compare(left, right, table: int, threshold: float, same: bool):
    """Links between two blocks of a bucket: how many copies each vector links with, and a smaller vector near it.

    A block is ``ids, copies, vectors, buckets``.  A pair is counted in the first table where it shares a bucket.
    Yields ``id, links, root`` rows; the roots connect what the links connect.
    """
    ids, copies, vectors, buckets = (np.concatenate(x) for x in zip(left, right, strict=True)) if not same else left
    cut = 0 if same else len(left[0])
    near = (vectors[: cut or None] @ vectors[cut:].T) >= threshold
    a, b = np.nonzero(np.triu(near, 1) if same else near)
    b = b + cut
    if not len(a):
        return []
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    first = ~(buckets[a, :table] == buckets[b, :table]).any(1)
    np.add.at(links, a[first], copies[b[first]])
    np.add.at(links, b[first], copies[a[first]])
    value = ids.copy()
    while True:
        least = np.minimum(value[a], value[b])
        new = value.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        if (new == value).all():
            break
        value = new
    root = value
    touched = np.union1d(a, b)
    return list(zip(ids[touched], links[touched], root[touched], strict=True))


def near_duplicates(
    vectors: DataFrame, threshold=THRESHOLD, recall=RECALL, id_col="vec_id", vector_col="embedding", block=BLOCK
) -> DataFrame:
    """Rows ``id, n_links, component_id, kept`` of every vector.

    Two vectors link if their cosine in double precision is at least ``threshold`` and they share a bucket in some
    table (see `tables_for`); no pair below the threshold links.  ``n_links`` counts the other rows linked
    with, ``component_id`` is the smallest id reachable by links, and ``kept`` marks the row that has it.

    Vectors that are null, empty or zero, or hold a null or a component that is not finite, link with nothing,
    and so do rows without an id (their component is null).  Vectors of different lengths never link.  Equal
    vectors are handled once, with their number: their ids count as one node, so an id on several vectors
    joins those.  An empty table gives an empty one.  Other columns are left out.

    A bucket larger than ``block`` is split into blocks, and pairs of blocks are compared in tasks of their own,
    so a group of any size is compared whole and in bounded memory.  Comparing gives a row for each vector with
    links, not one for each pair.
    """
    spark = ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("_id").isNotNull() & finite & F.exists("_v", lambda x: x != 0), F.lit(False))
    valid = rows.filter(usable)
    classes = written(valid.groupBy("_v").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_n")), "vector-classes")
    bits, tables = tables_for(classes.count(), threshold, recall)

    def sign(batches):
        for batch in batches:
            sizes = batch["_v"].map(len)
            for dims in sizes.unique():
                own = batch[sizes == dims]
                found = unit(np.stack(own["_v"].to_numpy()).astype(np.float64))
                at = signs(found, bits, tables)
                yield pd.DataFrame(
                    {
                        "_rep": own["_rep"].to_numpy(),
                        "_n": own["_n"].to_numpy(),
                        "_dims": dims,
                        "_unit": [v.tobytes() for v in found],
                        "_at": list(at),
                    }
                )

    signed = written(
        classes.mapInPandas(sign, "_rep long, _n long, _dims int, _unit binary, _at array<long>"), "vector-signs"
    )
    bucket = ["_dims", "_table", "_bucket"]
    counts = (
        signed.select("_dims", F.posexplode("_at").alias("_table", "_bucket"))
        .groupBy(bucket)
        .agg(F.count(F.lit(1)).alias("_size"))
        .filter("_size > 1")
        .withColumn("_blocks", F.ceil(F.col("_size") / block).cast("int"))
    )
    entries = signed.select("*", F.posexplode("_at").alias("_table", "_bucket")).join(counts.drop("_size"), bucket)
    own = F.pmod(F.xxhash64("_rep", "_table"), F.col("_blocks")).cast("int")
    pairs = (
        entries.withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumns({"_low": F.least("_own", "_other"), "_high": F.greatest("_own", "_other")})
        .select(*bucket, "_low", "_high", "_own", "_rep", "_n", "_unit", "_at")
    )

    def check(key, group):
        def side(part):
            v = np.frombuffer(b"".join(part["_unit"]), np.float64).reshape(len(part), -1)
            return part["_rep"].to_numpy(), part["_n"].to_numpy(), v, np.stack(part["_at"].to_numpy())

        _, table, _, low, high = key
        parts = [group[group["_own"] == x] for x in ((low,) if low == high else (low, high))]
        found = []
        if all(len(p) for p in parts):
            sides = [side(p) for p in parts]
            found = compare(sides[0], sides[-1], table, threshold, low == high)
        return pd.DataFrame(found, columns=["_rep", "_links", "_root"]).astype("int64")

    found = written(pairs.groupBy(*bucket, "_low", "_high").applyInPandas(check, "_rep long, _links long, _root long"), "vector-links")
    links = found.groupBy("_rep").agg(F.sum("_links").alias("_links"))
    reached = components(found.select(F.col("_rep").alias("src"), F.col("_root").alias("dst")))
    told = (
        classes.join(links, "_rep", "left")
        .join(reached.withColumnRenamed("id", "_rep"), "_rep", "left")
        .select("_v", "_n", "_links", F.coalesce("component", "_rep").alias("_component"))
    )
    linked = valid.join(told, "_v").select("_id", (F.coalesce("_links", F.lit(0)) + F.col("_n") - 1).alias("n_links"), "_component")
    alone = rows.filter(~usable).select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("_component"))
    return linked.union(alone).select(
        F.col("_id").alias(id_col),
        "n_links",
        F.col("_component").alias("component_id"),
        F.coalesce(F.col("_id") == F.col("_component"), F.lit(False)).alias("kept"),
    )
