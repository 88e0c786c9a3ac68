"""A ledger of numbered files: rows keep their numbers when files are added, wherever these sort."""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demandlens.session import cut_lineage

LEDGER = "_path string, _start long, _size long"


def running_starts(sizes: DataFrame, order, size: str, start: str) -> DataFrame:
    """Add ``start``: the sum of ``size`` over the rows before, by the ``order`` columns, which are unique.

    A distributed sort; within its parts sums run by themselves, and the parts' totals, one row for each, say where they start.
    The sorted rows are checkpointed, as where a part ends may change if it is computed again.
    """
    placed = cut_lineage(sizes.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(F.sum(size).alias("_total"))
    offsets = totals.select("_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    before = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumn("_own", F.coalesce(F.sum(size).over(before), F.lit(0)))
    # One row for each part of the sort: thousands at most.
    return own.join(F.broadcast(offsets), "_part").withColumn(start, F.col("_own") + F.col("_offset")).drop("_part", "_own", "_offset")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The files numbered so far: path, number of the first row and number of rows."""
    try:
        return spark.read.schema(LEDGER).option("recursiveFileLookup", True).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def enter_files(sizes: DataFrame, ledger: str) -> DataFrame:
    """Give numbers to the files of ``sizes`` (``_folder, _path, _size``) that the ledger does not know, after all it does.

    New files follow each other by folder and path.  They are written as one entry, in a folder of its own, so an
    entry is there as a whole or not at all; one writer at a time.  A known file that has another number of
    rows than when it was numbered raises.  Gives the whole ledger.
    """
    spark = sizes.sparkSession
    known = read_ledger(spark, ledger).select("_path", F.col("_size").alias("_known_size"), (F.col("_start") + F.col("_size")).alias("_end"))
    changed = sizes.join(known, "_path").filter("_size != _known_size").select("_path").take(1)
    if changed:
        raise ValueError(f"{changed[0][0]} has changed since its rows were numbered")
    after = known.agg(F.coalesce(F.max("_end"), F.lit(0))).first()[0]
    new = sizes.join(known.select("_path"), "_path", "left_anti")
    entry = running_starts(new, ["_folder", "_path"], "_size", "_start")
    if not new.isEmpty():
        entry.select("_path", (F.col("_start") + after).alias("_start"), "_size").write.parquet(f"{ledger}/entry={uuid.uuid4().hex}")
    return read_ledger(spark, ledger)
