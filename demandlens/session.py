"""Session helpers: a local session for tests and benches, and the shared checkpoint folder."""

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores="*", shuffle_partitions=8, app="demandlens") -> SparkSession:
    """A single-JVM session.  On a cluster use the session the cluster gives you instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        # Call sites of column expressions are for interactive debugging; recording them slows plan building.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; on a local master only, a temporary one.

    A cluster without that setting gets an error rather than a folder other machines cannot see.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured is None:
        configured = context.getCheckpointDir()
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="demandlens-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


_shipped = {}


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each application: their Python may not have it."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        folder = tempfile.TemporaryDirectory()  # the driver's own; executors fetch the file from the driver
        shutil.copytree(package, Path(folder.name, "src", package.name), ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(str(Path(folder.name, package.name)), "zip", Path(folder.name, "src")))
        _shipped[context.applicationId] = folder
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder, so that lost executors cannot change its rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
