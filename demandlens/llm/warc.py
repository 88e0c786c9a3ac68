"""WARC archives: a writer with revisit records, and a reader that splits compressed archives into byte ranges."""

import hashlib
import re
import uuid
import zlib

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.llm.common import scratch, written
from demandlens.session import ship

#: Formats of the archive.
GZIP_MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
RECORD_ID = "<urn:page:%s>"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 256 << 20
SPLIT_BYTES = 16 << 20
READ_BYTES = 1 << 20
#: The most that header lines take; a member without their end by then is no record.
HEADER_BYTES = 1 << 16
FILES = "path string, bytes long, records long"
RECORDS = (
    "record_id string, page_id long, url string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, digest_matches boolean, payload binary"
)


def open_store(folder: str):
    """The store and the path in it that ``folder`` names: local, HDFS, S3 or whatever else Arrow reads."""
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri("file://" + re.sub("^file:/*", "/", folder) if folder.startswith("file:") else folder)


def _clean(value) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to, date: str) -> bytes:
    """One record; a revisit keeps the response's HTTP headers but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    name = "" if page_id is None else str(page_id)
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {RECORD_ID % name}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {RECORD_ID % refers_to}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"])
    return VERSION + head.encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """``data`` as one gzip member; no time in it, so a repeated task writes the same bytes."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def _value(x):
    return None if x is None or x is pd.NA or x != x else x


def write_records(rows: DataFrame, folder: str, archive_bytes=ARCHIVE_BYTES, level=6, date="1970-01-01T00:00:00Z") -> DataFrame:
    """Write ``page_id, url, html, payload_bytes, payload_digest, refers_to`` rows as archives; their ``path, bytes, records``.

    Every record is a gzip member of its own.  A task writes its partition into archives of about
    ``archive_bytes``, each under a name of its attempt first and then renamed, so that a task which is lost or
    repeated leaves no half archive under a final name.
    """

    def write(batches):
        store, top = open_store(folder)
        context = TaskContext.get()
        part, out, count, size, number = context.partitionId(), None, 0, 0, 0
        own = f"{top}/_{part}-{context.taskAttemptId()}-{uuid.uuid4().hex}"

        def close():
            out.close()
            name = f"part-{part:06d}-{number:04d}.warc.gz"
            store.move(own, f"{top}/{name}")
            return pd.DataFrame({"path": [f"{folder}/{name}"], "bytes": [size], "records": [count]})

        store.create_dir(top, recursive=True)
        for batch in batches:
            for page, url, html, length, digest, first in zip(*(batch[c] for c in batch.columns), strict=True):
                if out is None:
                    out, count, size = store.open_output_stream(own), 0, 0
                page, first, html = _value(page), _value(first), _value(html)
                payload = None if first is not None else (html or "").encode()
                data = member(
                    record(
                        None if page is None else int(page), _value(url), payload, int(length), digest,
                        None if first is None else int(first), date,
                    ),
                    level,
                )
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    yield close()
                    out, number = None, number + 1
        if out is not None:
            yield close()

    ship(rows.sparkSession)
    columns = ["page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to"]
    # Ids go as text, for a null among numbers would make them floats.
    rows = rows.select(*columns).withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return written(rows.mapInPandas(write, FILES), "warc-files")


def with_revisits(pages: DataFrame, min_bytes=100) -> DataFrame:
    """Add ``payload_bytes, payload_digest, refers_to``: the smallest page with an equal payload, for the others.

    Payloads shorter than ``min_bytes`` refer to nothing.  Only ids and digests are shuffled to find the
    groups; the pages are then joined by id with the revisits alone.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"),
        F.sha2(html, 256).alias("payload_digest"),
    )
    ids = own.filter(F.col("payload_bytes") >= min_bytes).select("page_id", F.unhex("payload_digest").alias("digest"))
    first = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
    revisits = ids.join(first, "digest").filter("page_id != first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    revisits = written(revisits, "warc-revisits")
    same = (own["page_id"] == revisits["page_id"]) & (F.unhex(own["payload_digest"]) == revisits["digest"])
    return own.join(revisits, same, "left").select(own["*"], "refers_to")


def write_warc(pages: DataFrame, folder: str, min_bytes=100, **options) -> DataFrame:
    """Write a record for every row of ``pages`` (``page_id, url, html``) into ``folder``; the archives' ``path, bytes, records``.

    A null html is an empty payload and a null url is left out.  Of equal payloads of at least ``min_bytes``
    the smallest page is the response and the others are revisits of it.  Rows that repeat a page and its
    payload are each written, all with the same type; a row without an id is always a response.  Other columns
    are ignored.  An empty table gives no archive.
    """
    return write_records(with_revisits(pages, min_bytes), folder, **options)


class _Window:
    """A byte range of a file that is read on when more is needed, and forgotten behind."""

    def __init__(self, file, size, at):
        self.file, self.size, self.start, self.data = file, size, at, b""

    def get(self, at, n):
        """Bytes from ``at``: ``n`` of them, or up to the file's end."""
        while self.start + len(self.data) < min(at + n, self.size):
            self.file.seek(self.start + len(self.data))
            more = self.file.read(max(READ_BYTES, at + n - self.start - len(self.data)))
            if not more:
                break
            self.data += more
        return self.data[at - self.start : at - self.start + n]

    def find(self, what, at, end):
        """The first place from ``at`` and before ``end`` where ``what`` begins, or -1."""
        while at < end:
            found = self.get(at, min(READ_BYTES, end - at) + len(what) - 1).find(what)
            if found >= 0:
                return at + found
            at += READ_BYTES
        return -1

    def forget(self, at):
        self.data, self.start = self.data[at - self.start :], at


def read_member(window: _Window, at: int, keep: bool):
    """The record of the member that begins at ``at`` and where it ends; None if no valid member begins there."""
    undo, raw, head, position = zlib.decompressobj(31), b"", None, at
    seen = hashlib.sha256()
    body, length, skip = [], 0, 0
    while not undo.eof:
        data = window.get(position, READ_BYTES)
        if not data:
            return None
        try:
            out = undo.decompress(data)
        except zlib.error:
            return None
        position += len(data) - len(undo.unused_data)
        if head is None:
            raw += out
            if raw[: len(VERSION)] != VERSION[: len(raw)]:
                return None
            cut = raw.find(b"\r\n\r\n")
            if cut < 0:
                if len(raw) > HEADER_BYTES:
                    return None
                continue
            head = _headers(raw[len(VERSION) : cut])
            if not head.get("content-length", "").isdigit():
                return None
            rest, out, raw = int(head["content-length"]), raw[cut + 4 :], b""
            http = None
        if http is None:
            raw += out
            cut = raw.find(b"\r\n\r\n")
            if cut < 0 or cut + 4 > rest:
                continue
            http = _headers(raw[:cut].partition(b"\r\n")[2])
            skip, out, raw = cut + 4, raw[cut + 4 :], b""
        take = out[: max(0, rest - skip - length)]
        length += len(take)
        seen.update(take)
        if keep:
            body.append(take)
    if head is None or http is None or length != rest - skip:
        return None
    return head, http, length, seen.hexdigest(), b"".join(body) if keep else None, position


def _headers(raw: bytes) -> dict:
    pairs = (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n"))
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _page(urn):
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _row(found):
    head, http, length, seen, body, _ = found
    kind, digest = head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha256:")
    revisit = kind == "revisit"
    size = http.get("content-length", "")
    return (
        head.get("warc-record-id"), _page(head.get("warc-record-id")), head.get("warc-target-uri"), kind,
        _page(head.get("warc-refers-to")), int(size) if revisit and size.isdigit() else length,
        digest if revisit else seen, revisit or not digest or digest == seen, body,
    )


def read_warc(spark: SparkSession, files: DataFrame, split_bytes=SPLIT_BYTES, payloads=True) -> DataFrame:
    """The records of archives ``files`` (``path, bytes``), one row each; order is open.

    Every archive is split into ranges of ``split_bytes``, and each range is read by a task of its own, whatever
    archive it is in.  A task looks for the gzip magic in its range, and takes a member for real once its header
    decodes, its checksum holds and its length is as told; from then on the next member begins where one ends.
    It owns the records that start in its range, and reads past the end of it for the last.

    A response's size and digest are those of the payload read; ``digest_matches`` tells whether the header
    has the same.  A revisit has no payload; its size and digest are those that its headers tell.  Bytes that are no
    valid member are passed over.
    """
    fields = [field.split()[0] for field in RECORDS.split(", ")]

    def read(batches):
        for batch in batches:
            for path, size, start in zip(batch["path"], batch["bytes"], batch["start"], strict=True):
                store, name = open_store(path)
                end, rows, held = min(int(start) + split_bytes, int(size)), [], 0
                with store.open_input_file(name) as file:
                    window, at = _Window(file, int(size), int(start)), int(start)
                    while (at := window.find(GZIP_MAGIC, at, end)) >= 0:
                        window.forget(at)
                        found = read_member(window, at, payloads)
                        if found is None:
                            at += 1
                            continue
                        rows.append(_row(found))
                        at = found[-1]
                        held += len(found[4] or b"") + 200
                        if held > READ_BYTES * 8:
                            yield pd.DataFrame(rows, columns=fields).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=fields).astype({"page_id": "Int64", "refers_to": "Int64"})

    ship(spark)
    last = F.greatest(F.col("bytes") - 1, F.lit(0).cast("long"))
    starts = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(split_bytes).cast("long"))).alias("start"))
    return starts.repartition(2 * spark.sparkContext.defaultParallelism).mapInPandas(read, RECORDS)


def archive_round_trip(pages: DataFrame, min_bytes=100) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read their records back."""
    spark = pages.sparkSession
    files = write_warc(pages, scratch(spark, "warc"), min_bytes)
    return read_warc(spark, files, payloads=False)
