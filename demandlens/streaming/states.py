"""Tables that a stream keeps up to date: the market's demand, and the latest row of each key.

A streaming aggregate holds one state for each key in the state store that the session names
(``spark.sql.streaming.stateStore.providerClass``; RocksDB keeps it on disk).  Each batch writes the states it changed to
a folder of its own, so a batch run again after a failure overwrites what it had written.  Both states only ever move one way (counts
up, first sight down, order up), so the folders are merged by one aggregate, whatever their order or number.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from demandlens import rules
from demandlens.operators import market

KEYS = ["role", "level", "kind", "value"]


def keep_changes(states: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start writing the states of a streaming aggregate that each batch changes, to ``path/batch=N``."""

    def write_batch(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = states.writeStream.outputMode("update").foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """All that batches have written, and what a fold has put in place of earlier ones."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")


# ---- the market ---------------------------------------------------------------------------------


def run_market(jobs: DataFrame, path: str, checkpoint: str, title_rules=None, **trigger) -> StreamingQuery:
    """Start counting a stream of postings: postings, skills and companies of every role and level.

    Postings bring their own unique ``job_ord``, by which ties are settled; they may come in any order.  The state of an
    entry is how often and in which posting first it was seen.  A posting that comes twice counts twice.
    """
    return keep_changes(market.partial_demand(jobs, title_rules=title_rules), path, checkpoint, **trigger)


def merged(counts: DataFrame) -> DataFrame:
    """One row for each entry, from the states that any number of batches have written."""
    return counts.groupBy(*KEYS).agg(F.max("n").alias("n"), F.min("seen").alias("seen"))


def read_market(spark: SparkSession, path: str, k: int = rules.TOP_K) -> DataFrame:
    """The market slices of all postings so far, equal to ``market.market_slices`` of them."""
    return market.slices_of(market.profile_of(market.with_whole_roles(merged(read_changes(spark, path))), k))


def fold_market(spark: SparkSession, path: str, into: str) -> None:
    """Write the merged states to ``into`` as one batch, for when there are many folders.

    Run it between runs of the stream; a stream that goes on writes to ``into``, with its old checkpoint.
    """
    merged(read_changes(spark, path)).write.mode("errorifexists").parquet(f"{into}/batch=-1")


# ---- the latest row -----------------------------------------------------------------------------


def run_latest(stream: DataFrame, keys, order, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start keeping the row of each key that sorts last by the ``order`` columns, in whatever order rows arrive.

    ``order`` must be unique within a key.  A state holds the whole row: pass the columns that are needed, of a
    long text rather its place.
    """
    rest = [c for c in stream.columns if c not in (*keys, *order)]
    newest = F.max(F.struct(*order, *rest)).alias("_newest")
    states = stream.groupBy(*keys).agg(newest).select(*keys, "_newest.*").select(*stream.columns)
    return keep_changes(states, path, checkpoint, **trigger)


def read_latest(spark: SparkSession, path: str, keys, order) -> DataFrame:
    """The latest row of each key so far, equal to ``picks.latest`` of all rows."""
    changes = read_changes(spark, path)
    rest = [c for c in changes.columns if c not in (*keys, *order)]
    newest = changes.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_newest"))
    return newest.select(*keys, "_newest.*").select(*changes.columns)
