"""Reading and writing whole-file CV texts."""

import os
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import pyarrow as pa
except ModuleNotFoundError:  # then all is left to Spark's reader
    pa = None

from demandlens.session import ship

TXT_FILES = "*.txt"
# A task reads so many files at most, or as many bytes as Spark's own tasks if these are fewer files.
FILES = 20_000
# Texts leave a task when there are so many bytes or rows of them.
BATCH_BYTES, BATCH_ROWS = 1 << 22, 4096
# Files that Spark's reader unpacks by their names.
PACKED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst")
# What a path written as URI has as it is, of ASCII.
PLAIN = "_-!.~'()*:@&=+$,;/"


def file_stem(name) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def decoded(c) -> Column:
    """Text as read from a UTF-8 file: undecodable bytes dropped, line ends as ``\\n``."""
    c = F.col(c) if isinstance(c, str) else c
    repaired = F.replace(F.make_valid_utf8(c), F.lit("�"), F.lit(""))
    text = F.when(F.is_valid_utf8(c), c).otherwise(repaired)
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def _as_cvs(files: DataFrame) -> DataFrame:
    return files.select(
        F.xxhash64("_metadata.file_path").alias("cv_id"),
        file_stem(F.col("_metadata.file_name")).alias("cv_name"),
        decoded("value").alias("cv_text"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
    )


def _uri_part(name: str) -> str:
    """A file name as in the URI that Spark gives for the file."""
    if name.isascii():
        return quote(name, safe=PLAIN)
    return "".join(quote(c, safe=PLAIN) if ord(c) < 160 or c.isspace() else c for c in name)


def _local_folders(spark: SparkSession, paths) -> list[tuple[str, str]] | None:
    """Each folder's local path and URI, or nothing if a path is not simply a folder of the local file system."""
    if pa is None or any(spark.conf.get(f"spark.sql.files.ignore{k}Files", "false") == "true" for k in ("Missing", "Corrupt")):
        return None
    found, conf = [], spark._jsc.hadoopConfiguration()
    for path in paths:
        if any(c in path for c in "*?[]{}\\"):
            return None
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = folder.getFileSystem(conf)
        folder = system.makeQualified(folder)
        if folder.toUri().getScheme() != "file" or not system.exists(folder) or not system.getFileStatus(folder).isDirectory():
            return None
        found.append((folder.toUri().getPath(), "file:" + folder.toUri().getRawPath().rstrip("/")))
    return found if len({f for _, f in found}) == len(found) else None


def _listed(spark: SparkSession, folders, pattern) -> DataFrame:
    """Files of local folders, listed by tasks: ``folder, uri, name, size, at``, and ``odd`` where only Spark's reader will do.

    Odd are folders, links to nothing, checksums, packed files and names that are no UTF-8.
    """

    def entries(batches):
        kinds = [("folder", pa.string()), ("uri", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("at", pa.int64()), ("odd", pa.bool_())]
        schema, rows = pa.schema(kinds), []
        for batch in batches:
            for folder, uri in zip(batch["folder"].to_pylist(), batch["uri"].to_pylist(), strict=True):
                with os.scandir(folder) as found:
                    for entry in found:
                        name, sound = entry.name, entry.name.isascii() or not any("\ud800" <= c <= "\udfff" for c in entry.name)
                        if name.startswith(".") and name.endswith(".crc") or not sound or not entry.is_file():
                            rows.append((folder, uri, "" if not sound else name, 0, 0, True))
                        elif not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")):
                            known = entry.stat()
                            rows.append((folder, uri, name, known.st_size, known.st_mtime_ns // 1_000_000, False))
                        if len(rows) >= BATCH_ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    ship(spark)
    named = spark.createDataFrame(folders, "folder string, uri string")
    found = named.mapInArrow(entries, "folder string, uri string, name string, size long, at long, odd boolean")
    regex = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
    packed = F.lit(False)
    for ending in PACKED:
        packed = packed | F.lower("name").endswith(ending)
    return found.filter(F.col("odd") | F.col("name").rlike(f"\\A(?s:{regex})\\z")).withColumn("odd", F.col("odd") | packed)


def _read(batches):
    """Listed files with what they hold."""
    names = ["_path", "_name", "_at", "value"]
    rows, held = [], 0
    for batch in batches:
        for folder, uri, name, at in zip(*(batch[c].to_pylist() for c in ("folder", "uri", "name", "at")), strict=True):
            with open(f"{folder}/{name}", "rb") as file:
                value = file.read()
            own = _uri_part(name)
            rows.append((f"{uri}/{own}", own, at, value))
            held += len(value)
            if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)


def read_cv_texts(spark: SparkSession, path, pattern=TXT_FILES) -> DataFrame:
    """Text files of a folder, or of a list of them, as ``cv_id, cv_name, cv_text, modified_at``; without any it raises.

    ``cv_id`` is a hash of the path; no operator mixes up rows that happen to share it.  Plain local folders are listed
    and read by tasks, anew for each action, and the driver knows no file by its name.  Patterns in a path, other file systems, folders in folders
    and packed files are left to Spark's reader, for which the driver holds every name.
    """
    folders = _local_folders(spark, [path] if isinstance(path, str) else path)
    if folders:
        listed = _listed(spark, folders, pattern)
        files, size, odd = listed.agg(F.count(F.lit(1)), F.sum("size"), F.max("odd")).first()
        if not files:
            raise FileNotFoundError(f"no text files in {path}")
        if not odd:
            most = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
            tasks = max(min(files, spark.sparkContext.defaultParallelism), -(-size // most), -(-files // FILES))
            # Spark's reader has no row for an empty file.
            rows = listed.filter("size > 0").select("folder", "uri", "name", "at").repartition(tasks)
            found = rows.mapInArrow(_read, "_path string, _name string, _at long, value binary")
            return found.select(
                F.xxhash64("_path").alias("cv_id"),
                file_stem(F.col("_name")).alias("cv_name"),
                decoded(F.col("value").cast("string")).alias("cv_text"),
                F.timestamp_millis("_at").alias("modified_at"),
            )
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    # Counted where they are: their names, of which there may be very many, stay there.
    if not len(files._jdf.inputFiles()):
        raise FileNotFoundError(f"no text files in {path}")
    return _as_cvs(files)


def stream_cv_texts(spark: SparkSession, path, pattern=TXT_FILES, files_per_batch=1000) -> DataFrame:
    """The same files as a stream: each file once, when it arrives."""
    reader = spark.readStream.option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch)
    return _as_cvs(reader.text(path, wholetext=True))


def write_cv_texts(cvs: DataFrame, path, mode="append") -> None:
    """Keep extracted texts as a table."""
    cvs.select("cv_id", "cv_name", "cv_text").write.mode(mode).parquet(path)
