"""What several operators share: tables in the shared folder, gapless numbers, and the columns of a record."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demandlens.session import shared_dir

#: The white space that the contracts name.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the session names."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec="snappy", path: str | None = None, **options) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and safe when executors are lost.

    Spark knows the size of what it reads back, so it broadcasts such a table only if it is small.  ``options`` are the
    writer's.
    """
    path = path or scratch(df.sparkSession, name)
    df.write.options(compression=codec, **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str):
    """Remove a table of ``scratch`` that was read for the last time."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def under_own_names(docs: DataFrame, fn, *columns: str) -> DataFrame:
    """``fn`` of ``docs`` and of the named ``columns``, with all columns renamed meanwhile, so that none can clash."""
    names = {c: f"own{i}" for i, c in enumerate(docs.columns)}
    return fn(docs.toDF(*names.values()), *(names[c] for c in columns)).toDF(*docs.columns)


#: Bits of a filter; 64 to a row, so 65,536 rows at most.
FILTER_BITS = 1 << 22


def told_apart(df: DataFrame, value: str, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows whose ``value`` may be a ``key`` of ``keys``, and rows whose value is none for certain.

    The filter is a bit for each key's hash, in a table of a fixed size that is broadcast.  A join of the first
    part moves little more than the rows that match; with very many keys the filter fills up and lets more through.
    """

    def bit(c):
        return F.xxhash64(c).bitwiseAND(F.lit(FILTER_BITS - 1))

    word, place = "shiftright(_bit, 6)", "cast(_bit & 63 as int)"
    words = keys.select(bit(key).alias("_bit")).groupBy(F.expr(word).alias("_word"))
    words = words.agg(F.bit_or(F.expr(f"shiftleft(1L, {place})")).alias("_bits"))
    marked = df.withColumn("_bit", bit(value)).withColumn("_word", F.expr(word)).join(F.broadcast(words), "_word", "left")
    maybe = F.coalesce(F.expr(f"(shiftright(_bits, {place}) & 1) = 1"), F.lit(False))
    return marked.filter(maybe).select(*df.columns), marked.filter(~maybe).select(*df.columns)


def numbered(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Add ``name``: numbers from 0 without gaps within each ``key``, in tasks that stay small whatever the key holds.

    The rows of a key are split by a hash of ``order``; each part is numbered by itself and moved up by the
    sizes of the parts before it.  ``df`` is read twice, so pass a written table.  Of the sizes there is one
    row for each key and part.  Which of several equal rows gets which number is open.
    """
    parts = shuffle_partitions(df.sparkSession)
    split = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        split.groupBy(key, "_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(key, "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    own = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)).cast("long") - 1
    return (
        split.withColumn("_own", own)
        .join(sizes, [key, "_part"])
        .withColumn(name, F.col("_own") + F.col("_before"))
        .drop("_own", "_before", "_part")
    )
