"""Exact deduplication of a stream of documents, with keyed state on disk; built-in functions only."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandlens.llm.common import BLANK_RUN, scratch, told_apart, under_own_names, written

#: State on disk, and let go by an executor once it is committed: few batches follow, and each part takes megabytes.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: Bytes of intake (digests and places, not texts) in one micro-batch.
BATCH_BYTES = 1 << 30


def normalised(text_col) -> Column:
    """The text with every run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), BLANK_RUN, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _located(docs: DataFrame, id_col, text_col) -> DataFrame:
    """``_id, _file, _row, _text``: where content lies; rows that no file holds get their id and a hash."""
    columns = {"_id": F.col(id_col).cast("long"), "_text": normalised(text_col)}
    try:
        at = {"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")}
        return docs.select(*[c.alias(n) for n, c in (columns | at).items()])
    except AnalysisException:
        at = {"_file": F.coalesce(F.col(id_col).cast("string"), F.lit("")), "_row": F.xxhash64(text_col)}
        return docs.select(*[c.alias(n) for n, c in (columns | at).items()])


def drain(spark: SparkSession, intake: str, schema, batch_bytes=BATCH_BYTES) -> DataFrame:
    """Stream the folder ``intake`` (``_id, digest, _file, _row``) through keyed state on disk.

    The state never expires.  For each digest it holds the smallest id, where that content lies, and how many
    rows had it.  Every micro-batch writes the states that it changed into a folder of its own, so a batch
    that is repeated overwrites itself; the newest state of each digest is returned.
    """
    out, before = scratch(spark, "exact-state"), {k: spark.conf.get(k, None) for k in STATE_STORE}
    # Null ids come last, so that a group is named by an id where it has one.
    place = F.struct(F.col("_id").isNull().alias("none"), "_id", "_file", "_row")
    state = (
        spark.readStream.schema(schema)
        .option("maxBytesPerTrigger", batch_bytes)
        .parquet(intake)
        .groupBy("digest")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"))
    )

    def publish(changed, batch):
        changed.write.mode("overwrite").parquet(f"{out}/changes/batch={batch}")

    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        run = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{out}/progress")
            .trigger(availableNow=True)
            .foreachBatch(publish)
            .start()
        )
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    changes = T.StructType(
        [schema["digest"]]
        + T.StructType.fromDDL("first struct<none:boolean,_id:long,_file:string,_row:long>, copies long, batch int").fields
    )
    return (
        spark.read.schema(changes)
        .parquet(f"{out}/changes")
        .groupBy("digest")
        .agg(F.max_by(F.struct("first", "copies"), "batch").alias("s"))
        .select("digest", "s.first", "s.copies")
    )


def exact_dedup(docs: DataFrame, id_col="doc_id", text_col="text", digest=None, batch_bytes=BATCH_BYTES) -> DataFrame:
    """Rows ``id, keep_id, group_size, kept, text_sha256`` of every document, dropped ones too.

    Texts are equal if they are the same bytes after runs of white space became single spaces; null counts as
    empty.  The smallest id of a group stays; rows that repeat it are all marked kept.  A null id is never
    smallest: it names a group only if the group has no other.  ``digest`` makes the key of the state from the
    SHA-256 (by default, itself).  An empty table gives an empty one.  Other columns are ignored.

    Digests go through the state (`drain`), texts do not.  Of documents whose digest repeats, the whole text is
    compared with the text that the state points to; where it differs (two texts with one digest), the rows of
    that digest which differ are grouped by their text.  Other texts are not shuffled, but for the few that
    a filter of a fixed size lets through (`told_apart`).
    """
    spark = docs.sparkSession
    located = _located(docs, id_col, text_col)
    sha = sha256(F.col("_text"))
    digest = digest or (lambda sha: sha)
    intake = located.select("_id", digest(sha).alias("digest"), sha.alias("sha"), "_file", "_row")
    folder = scratch(spark, "exact-intake")
    intake.write.parquet(folder)
    intake = spark.read.schema(intake.schema).parquet(folder)
    state = written(drain(spark, folder, intake.schema, batch_bytes), "exact-state-last")

    # Only texts whose digest may repeat are moved.
    repeated = state.filter("copies > 1")
    hits, _ = told_apart(located.withColumn("digest", digest(sha)), "digest", repeated, "digest")
    leads = F.struct("_file", "_row") == F.struct("first._file", "first._row")
    texts = written(
        hits.join(repeated, "digest").select("_id", "_file", "_row", "digest", "_text", leads.alias("leads")), "exact-hits"
    )
    leaders = texts.filter("leads").select("digest", F.col("_text").alias("_lead")).dropDuplicates(["digest"])
    # Texts that share a digest with another text; as good as always none.
    odd = written(
        texts.join(leaders, "digest").filter("_text != _lead").select("_id", "_file", "_row", "digest", "_text"), "exact-odd"
    )
    grouped = intake.join(state, "digest")
    own = odd.groupBy("digest", "_text").agg(F.min("_id").alias("_own_id"), F.count(F.lit(1)).alias("_own_size"))
    own = odd.join(own, ["digest", "_text"]).select("_file", "_row", "_own_id", "_own_size").distinct()
    away = odd.groupBy("digest").agg(F.count(F.lit(1)).alias("_away"))
    rows = grouped.join(written(own, "exact-own"), ["_file", "_row"], "left").join(
        written(away, "exact-away"), "digest", "left"
    )
    keep = F.when(F.col("_own_size").isNotNull(), F.col("_own_id")).otherwise(F.col("first._id"))
    return rows.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_own_size", F.col("copies") - F.coalesce("_away", F.lit(0))).alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.  Rows that repeat a kept id and its text stay once."""
    return under_own_names(docs, _keep_first, id_col, text_col)


def _keep_first(docs: DataFrame, id_col, text_col) -> DataFrame:
    found = exact_dedup(docs, id_col, text_col).filter("group_size > 1")
    pairs = found.filter("kept").select(F.unhex("text_sha256").alias("_sha"), F.col("keep_id").alias("_keep")).distinct()
    pairs = written(pairs, "exact-kept")
    hits, others = told_apart(docs.withColumn("_sha", sha256(normalised(text_col))), "_sha", pairs, "_sha")
    single = hits.join(pairs.select("_sha").distinct(), "_sha", "left_anti").select(hits.columns)
    same = (hits["_sha"] == pairs["_sha"]) & hits[id_col].cast("long").eqNullSafe(pairs["_keep"])
    first = hits.join(pairs, same, "left_semi").dropDuplicates([id_col, "_sha"])
    return others.union(single).union(first).drop("_sha")
