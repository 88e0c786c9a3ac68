"""Lines that many documents share, dropped by levelled sorted runs of line hashes; built-in functions only."""

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.functions.text import bind
from demandlens.llm.common import BLANKS, removed, scratch, shuffle_partitions, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs on a level before they are compacted into one run on the next.
FANOUT = 4
#: Bytes of line hashes and ids in one batch, for each core.
BATCH_BYTES = 8 << 20
LISTED = "place int, level int, name string, buckets int, min_docs int"


def line_key(line) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


class LineRuns:
    """Sorted runs of ``hash, who``: which lines were found in which documents, batch after batch and call after call.

    Runs are tables bucketed and sorted by both columns, so that a batch meets them by merge joins which move only
    the batch, and no document with very many lines or line in very many documents fills one bucket.  A batch is
    anti-joined with the settled lines and with every run, and adds what is left as a run of its own; so a pair of
    line and document is in one run at most, counts of runs add up, and adding a batch again adds nothing.  A level
    with ``fanout`` runs is compacted into one run on the next level.  A line found in ``min_docs`` documents of a
    batch, or of what is compacted, is settled: only its hash is kept, and its pairs go with the next compaction.

    The runs live in ``folder``, with a list of them that is written anew, under the next number, after each step.
    `LineRuns` of a folder that has such a list goes on from the newest, so a lost driver costs one batch.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout=FANOUT, folder: str | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.folder, self.buckets, self.version = folder or scratch(spark, "line-runs"), shuffle_partitions(spark), 0
        self.levels, self.settled = [[]], []
        self._open()

    def _open(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/lists")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = files.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(path, "*/_SUCCESS")) if files.exists(path) else []
        versions = [int(f.getPath().getParent().getName()) for f in done]
        if not versions:
            return
        self.version = max(versions)
        for row in self.spark.read.schema(LISTED).json(f"{self.folder}/lists/{self.version}").orderBy("place").collect():
            self.buckets, self.min_docs = row["buckets"], row["min_docs"]
            if row["name"] is None:
                continue
            columns = ["hash"] if row["level"] < 0 else ["hash", "who"]
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {row['name']} (hash BINARY{', who STRING' if len(columns) > 1 else ''}) USING parquet "
                f"CLUSTERED BY ({', '.join(columns)}) SORTED BY ({', '.join(columns)}) INTO {self.buckets} BUCKETS "
                f"LOCATION '{self.folder}/{row['name']}'"
            )
            if row["level"] < 0:
                self.settled.append(row["name"])
            else:
                self.levels += [[] for _ in range(row["level"] + 1 - len(self.levels))]
                self.levels[row["level"]].append(row["name"])

    def _list(self):
        named = [(i, name) for i, level in enumerate(self.levels) for name in level] + [(-1, name) for name in self.settled]
        rows = [(k, i, name, self.buckets, self.min_docs) for k, (i, name) in enumerate(named or [(0, None)])]
        self.version += 1
        self.spark.createDataFrame(rows, LISTED).coalesce(1).write.mode("overwrite").json(f"{self.folder}/lists/{self.version}")

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows = rows.repartition(self.buckets, *rows.columns).write.bucketBy(self.buckets, *rows.columns).sortBy(*rows.columns)
        rows.option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _drop(self, names: list[str]):
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            removed(self.spark, f"{self.folder}/{name}")

    def _all(self, names: list[str]) -> DataFrame:
        return reduce(DataFrame.union, [self.spark.table(name) for name in names])

    def _unsettled(self, pairs: DataFrame, names: list[str]) -> DataFrame:
        for name in names:
            pairs = pairs.join(self.spark.table(name), "hash", "left_anti")
        return pairs

    def _found(self, pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("hash").agg(F.count(F.lit(1)).alias("_docs")).filter(F.col("_docs") >= self.min_docs).select("hash")

    def add(self, batch: DataFrame):
        """Add a batch of ``hash, who``, which may repeat pairs of its own or of earlier batches."""
        fresh = self._unsettled(batch.select("hash", "who").distinct(), self.settled)
        for level in self.levels:
            for name in level:
                fresh = fresh.join(self.spark.table(name).hint("merge"), ["hash", "who"], "left_anti")
        run = self._write(fresh)
        self.levels[0].append(run)
        self.settled.append(self._write(self._found(self.spark.table(run))))
        gone = []
        for i, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                gone += self._compact(i)
        if len(self.settled) >= self.fanout:
            gone, self.settled = gone + self.settled, [self._write(self._all(self.settled).distinct())]
        self._list()
        self._drop(gone)

    def _compact(self, i: int) -> list[str]:
        merged = self._unsettled(self._all(self.levels[i]), self.settled)
        found = self._write(self._found(merged))
        if i + 1 == len(self.levels):
            self.levels.append([])
        self.levels[i + 1].append(self._write(self._unsettled(merged, [found])))
        self.settled.append(found)
        gone, self.levels[i] = self.levels[i], []
        return gone

    def frequent(self) -> DataFrame:
        """The hashes found in ``min_docs`` documents over all batches."""
        names = [name for level in self.levels for name in level]
        if not names:
            return self.spark.createDataFrame([], "hash binary")
        open_pairs = self._unsettled(self._all(names), self.settled)
        return self._found(open_pairs).union(self._all(self.settled)).distinct()

    def close(self):
        """Forget the tables; the runs stay in the folder for another `LineRuns`."""
        for name in [name for level in self.levels for name in level] + self.settled:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def line_dedup(
    docs: DataFrame, min_docs=10, id_col="doc_id", text_col="text", batch_bytes=BATCH_BYTES, fanout=FANOUT, folder: str | None = None
) -> DataFrame:
    """Rows ``id, n_lines, n_dropped, kept_text``: documents without the lines found in ``min_docs`` documents.

    Lines end at a newline; a null or empty text is one empty line.  A line is found by its key (`line_key`);
    an empty key is never dropped.  All lines of a frequent key go, in every document.  Documents are told apart
    by id: rows that repeat an id count as one document, and so do all rows with a null id.  Every row comes out
    once.  An empty table gives an empty one.  Other columns are left out.

    With a ``folder``, the runs of lines stay there: a later call with it counts the documents of earlier calls too
    (ids seen before are the same documents), and goes on with the ``min_docs`` that the folder began with.

    Hashes arrive at the runs (`LineRuns`) in batches of ``batch_bytes`` a core, and each text is shuffled once to
    lose its lines.  A line that a third of all documents hold is spread by document, and counted inside tasks
    first; the join back to documents can be split.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    whole = whole.withColumn("_row", F.unhex(F.md5(F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit("\n"), "_text"))))
    listed = whole.select("_row", "_id", F.posexplode(F.split("_text", "\n")).alias("_at", "_line"))
    keyed = listed.withColumn("_key", line_key(F.col("_line"))).filter("_key != ''")
    who = F.coalesce(F.concat(F.lit("="), F.col("_id").cast("string")), F.lit("")).alias("who")
    hashes_folder = scratch(spark, "line-hashes")
    keyed.select("_row", who, "_at", F.unhex(F.md5("_key")).alias("hash")).write.parquet(hashes_folder)
    hashes = spark.read.parquet(hashes_folder)

    runs = LineRuns(spark, min_docs, fanout, folder)
    try:
        size = batch_bytes * spark.sparkContext.defaultParallelism
        batches = spark.readStream.schema(hashes.schema).option("maxBytesPerTrigger", size).parquet(hashes_folder).writeStream
        batches = batches.option("checkpointLocation", scratch(spark, "line-progress")).trigger(availableNow=True)
        batches.foreachBatch(lambda batch, _: runs.add(batch)).start().awaitTermination()
        frequent = written(runs.frequent(), "line-frequent")
    finally:
        runs.close()
    if folder is None:
        removed(spark, runs.folder)
    dropped = hashes.join(frequent, "hash").groupBy("_row").agg(F.collect_set("_at").alias("_dropped"))

    def kept(lines):
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_dropped"))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    return whole.join(dropped, "_row", "left").select(
        F.col("_id").alias(id_col),
        F.size(F.split("_text", "\n")).cast("long").alias("n_lines"),
        F.when(F.col("_dropped").isNull(), 0).otherwise(F.size("_dropped")).cast("long").alias("n_dropped"),
        F.when(F.col("_dropped").isNull(), F.col("_text")).otherwise(bind(F.split("_text", "\n"), kept)).alias("kept_text"),
    )
