"""Tables written to be read as streams."""

import os

from demandlens.plans import queries
from pyspark.sql import functions as F


def test_more_rows_go_to_more_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # parts this small would be put together
    try:
        stream = queries._in_batches(spark, spark.range(1000), str(tmp_path / "in"), "id")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(f.endswith(".parquet") for f in os.listdir(tmp_path / "in")) == 8
    taken = []
    writer = stream.writeStream.foreachBatch(lambda df, _: taken.append(df.agg(F.count("id"), F.sum("id")).first()))
    writer.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    assert len(taken) == 3 and sum(n for n, _ in taken) == 1000 and sum(s for _, s in taken) == 499500
