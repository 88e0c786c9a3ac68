"""Scoring CVs as they arrive.

The stream is stateless: each CV is gated, classified, looked up in the market and scored by itself.
The market comes from a published table of a few dozen rows, never from the postings: a static
side of a stream is planned anew for every batch, so it has to be cheap to read.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from demandlens.functions.text import is_valid_text
from demandlens.operators.feedback import with_feedback
from demandlens.operators.gap import result_record, route, skill_gap, text_cvs
from demandlens.operators.market import market_slices


def publish_market(jobs: DataFrame, path: str, version: int) -> None:
    """Compute the market slices of the postings and store them as one version of a table.

    A version that exists raises: running readers may be using it.
    """
    publish_slices(market_slices(jobs), path, version)


def publish_slices(slices: DataFrame, path: str, version: int) -> None:
    """Store market slices as one version of a table (see `publish_market`)."""
    slices.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_market(spark: SparkSession, path: str) -> DataFrame:
    """The newest published version.  A version is a folder of its own, written once."""
    versions = spark.read.parquet(path)
    newest = versions.agg(F.max("version")).first()[0]
    return versions.filter(F.col("version") == newest).drop("version")


def score_stream(stream: DataFrame, slices: DataFrame, fn=None) -> DataFrame:
    """Result records of the CVs of a stream (or a table) that pass the gate and whose role is hired for.

    ``fn`` answers their feedback prompts (see ``feedback.model_answers``).
    """
    return result_record(with_feedback(skill_gap(text_cvs(stream.filter(is_valid_text("cv_text"))), slices), fn))


def run_intake(stream: DataFrame, market_path: str, out_path: str, checkpoint: str, fn=None, **trigger) -> StreamingQuery:
    """Start writing every arriving CV, accepted or rejected, to ``out_path``.

    Each batch reads the newest market and fills a folder of its own, ``batch=N/status=S``; a batch
    run again after a failure overwrites that folder, so nothing is written twice.  ``fn`` answers the feedback
    prompts of accepted CVs.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        slices = load_market(batch.sparkSession, market_path)
        routed = route(batch, slices, fn)
        routed.write.mode("overwrite").partitionBy("status").parquet(f"{out_path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_intake(spark: SparkSession, out_path: str) -> DataFrame:
    """What an intake has written so far."""
    return spark.read.option("basePath", out_path).parquet(f"{out_path}/batch=*")
