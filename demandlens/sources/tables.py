"""Reading postings and table CVs from folders of files."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from demandlens import schemas
from demandlens.session import cut_lineage
from demandlens.sources.ledger import enter_files, running_starts

# Files whose names and starts are broadcast; of more, rows are joined with theirs.
BROADCAST_FILES = 50_000


def conform(df: DataFrame, schema: T.StructType, required=()) -> DataFrame:
    """The columns of ``schema``, in order and type.

    An absent column reads as an empty string (or null for other types); an absent required one raises.
    """
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"missing required columns: {', '.join(absent)}")

    def column(field):
        if field.name in df.columns:
            return F.col(field.name).cast(field.dataType).alias(field.name)
        empty = F.lit("") if isinstance(field.dataType, T.StringType) else F.lit(None)
        return empty.cast(field.dataType).alias(field.name)

    return df.select(*[column(f) for f in schema.fields])


def union_by_name(frames) -> DataFrame:
    """All rows of all frames; a column some frame lacks is null there.  No frame at all raises."""
    frames = list(frames)
    if not frames:
        raise ValueError("no tables to combine")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def renumber(df: DataFrame, order_by, out_col="job_ord") -> DataFrame:
    """Number the rows 0, 1, 2, ... by the ``order_by`` columns.

    A distributed sort, numbered per partition; the offsets come from one row per partition.  The
    sorted rows are written to the checkpoint folder first, so recomputing a lost task cannot shift a number.
    """
    mask = (1 << 33) - 1
    placed = cut_lineage(
        df.orderBy(*order_by).withColumns(
            {"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit(mask))}
        )
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    # One offset per shuffle partition of the sort: thousands of rows at most.
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(out_col, F.col("_offset") + F.col("_row"))
        .drop("_part", "_row", "_offset")
    )


def _file_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("_folder", "_path").agg(F.count(F.lit(1)).alias("_size"))


def _numbered(df: DataFrame, starts: DataFrame, files: int, out_col) -> DataFrame:
    starts = F.broadcast(starts) if files <= BROADCAST_FILES else starts
    placed = df.join(starts, [c for c in ("_folder", "_path") if c in starts.columns])
    return placed.withColumn(out_col, F.col("_start") + F.col("_row")).drop("_folder", "_path", "_row", "_start")


def number_by_file(df: DataFrame, out_col="job_ord") -> DataFrame:
    """Number the rows 0, 1, 2, ... by ``_folder``, ``_path`` and the row's place ``_row`` in its file.

    Rows are counted for each file, from metadata alone, and each file's rows start after those of the files
    before it.  Up to ``BROADCAST_FILES`` files nothing is sorted or shuffled but their counts; of more, the counts are
    added up by a distributed sort and joined as Spark sees fit.  A repeated task gives the same numbers.
    """
    files, sizes = len(df.inputFiles()), _file_sizes(df)
    if files <= BROADCAST_FILES:
        before = Window.orderBy("_folder", "_path").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select("_folder", "_path", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    else:
        starts = running_starts(sizes, ["_folder", "_path"], "_size", "_start").drop("_size")
    return _numbered(df, starts, files, out_col)


def number_by_ledger(df: DataFrame, ledger: str, out_col="job_ord") -> DataFrame:
    """Number the rows as `number_by_file` does, but files that ``ledger`` knows keep the numbers it gave them.

    New files are entered into the ledger (see `ledger.enter_files`) and numbered after all others, wherever they sort.
    """
    starts = enter_files(_file_sizes(df), ledger).select("_path", "_start")
    return _numbered(df, starts, len(df.inputFiles()), out_col)


def _table_folders(spark: SparkSession, path, pattern) -> int | None:
    """How deep ``path`` is, if folders right under it have names that ``pattern`` picks; otherwise None."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    picked = hadoop.Path(path, pattern)
    files = picked.getFileSystem(conf)
    folders = [s.getPath().getName() for s in files.globStatus(picked) or [] if s.isDirectory()]
    # Partition folders are Spark's to look into, and names like these are hidden from it.
    if not any("=" not in name and name[0] not in "_." for name in folders):
        return None
    return files.makeQualified(hadoop.Path(path)).depth()


def read_folder(
    spark: SparkSession, path, fmt="parquet", schema=None, pattern=None, merge_schema=False, **options
) -> DataFrame:
    """Every file of a folder as one table, with ``source_file``; a folder without files raises.

    Parquet files of a folder share a schema; ``merge_schema`` looks into all of them for columns that some lack.

    ``pattern`` filters file names (case-sensitive unless it says otherwise, as ``*.[cC][sS][vV]``).  A table that was written
    as a folder of part files is picked by its own name, which all its rows get; where there is such a one, partition
    folders beside it are not looked into.
    A CSV file whose header disagrees with ``schema`` raises; read such folders one by one and
    combine them with ``union_by_name``.
    """
    reader = spark.read.format(fmt).options(**options)
    depth = _table_folders(spark, path, pattern) if pattern else None
    if pattern and depth is None:
        reader = reader.option("pathGlobFilter", pattern)
    if fmt == "csv":
        reader = reader.options(header="true", enforceSchema="false")
    if fmt == "parquet" and schema is None:
        reader = reader.option("mergeSchema", str(merge_schema).lower())
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path if depth is None else f"{path}/{pattern}")
    if not df.inputFiles():
        raise ValueError(f"no matching files in {path}")
    if depth is None:
        return df.withColumn("source_file", F.col("_metadata.file_name"))
    place = F.regexp_replace("_metadata.file_path", "^[^/:]+:(//[^/]*)?", "")
    return df.withColumn("source_file", F.split(place, "/")[depth + 1])


def read_postings(spark: SparkSession, paths, fmt="parquet", row_key=None, pattern=None, ledger=None, **options) -> DataFrame:
    """Postings of one or more folders, combined by column name, in the shape of ``schemas.JOBS``.

    Rows keep a ``job_ord`` column they bring along; it must be unique.  Otherwise they are numbered by
    folder, file path and ``row_key`` (for parquet, by default, the row's place in its file).  With a ``ledger``, a folder of
    its own, numbers last: files added later are numbered after those that are there, so ties of demand do not
    shift.  It needs the rows' places, so no ``row_key``.
    """
    if ledger is not None and row_key is not None:
        raise ValueError("a ledger numbers rows by their place in a file, not by a row_key")
    frames = []
    for at, path in enumerate([paths] if isinstance(paths, str) else paths):
        df = read_folder(spark, path, fmt, pattern=pattern, **options)
        if "job_ord" not in df.columns and row_key is None:
            if fmt != "parquet":
                raise ValueError("name a row_key column: only parquet records the place of a row in its file")
            df = df.withColumn("_row", F.col("_metadata.row_index"))
        frames.append(df.withColumns({"_folder": F.lit(at), "_path": F.col("_metadata.file_path")}))
    df = union_by_name(frames)
    if "job_ord" not in df.columns:
        if ledger is not None:
            df = number_by_ledger(df, ledger)
        else:
            df = number_by_file(df) if row_key is None else renumber(df, ["_folder", "_path", row_key])
    return conform(df, schemas.JOBS, schemas.JOBS_REQUIRED)


def read_cvs(spark: SparkSession, paths, fmt="parquet", pattern=None, **options) -> DataFrame:
    """Table CVs of one or more folders, in the shape of ``schemas.CVS``.  ``cv_id`` must be in the files."""
    frames = [
        read_folder(spark, path, fmt, pattern=pattern, **options)
        for path in ([paths] if isinstance(paths, str) else paths)
    ]
    return conform(union_by_name(frames), schemas.CVS, ["cv_id"])
