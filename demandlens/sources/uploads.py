"""Uploaded CVs as lines of JSON, read so that a broken upload is a row with an error and harms no other."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandlens.sources.tables import read_folder
from demandlens.sources.texts import decoded

BROKEN = "_broken"
# All strings: Spark reads no field that a query does not ask for, so a field of the wrong type has to be found here.
FIELDS = ["cv_id", "cv_name", "file_name", "modified_at", "content", BROKEN]
UPLOAD = T.StructType([T.StructField(name, T.StringType()) for name in FIELDS])


def conform_uploads(lines: DataFrame) -> DataFrame:
    """Uploads (``UPLOAD``) as text CVs with ``file_name`` and ``processing_error``, which is null for those in order.

    In error are lines that are no JSON, records without a number as ``cv_id`` or with a time that is none, and contents that
    are no base64.  What can be read of them stays.  Bytes that are no UTF-8 are left out of a text.  An absent content is
    an empty text, no error.
    """
    text = decoded(F.try_to_binary("content", F.lit("base64")).cast("string"))
    cv_id, modified = F.col("cv_id").try_cast("long"), F.col("modified_at").try_cast("timestamp")
    error = (
        F.when(F.col(BROKEN).isNotNull(), "record cannot be read")
        .when(cv_id.isNull(), "record has no cv_id")
        .when(F.col("modified_at").isNotNull() & modified.isNull(), "time cannot be read")
        .when(F.col("content").isNotNull() & text.isNull(), "content cannot be decoded")
    )
    return lines.select(
        cv_id.alias("cv_id"),
        "cv_name",
        text.alias("cv_text"),
        modified.alias("modified_at"),
        "file_name",
        error.alias("processing_error"),
    )


def read_uploads(spark: SparkSession, path, pattern=None) -> DataFrame:
    """Uploads of a folder of JSON lines, gzipped or not (see `conform_uploads`)."""
    lines = read_folder(spark, path, "json", schema=UPLOAD, pattern=pattern, mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN)
    return conform_uploads(lines)


def stream_uploads(spark: SparkSession, path, **options) -> DataFrame:
    """Uploads of a folder as they arrive."""
    reader = spark.readStream.schema(UPLOAD).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN)
    return conform_uploads(reader.options(**options).json(path))
