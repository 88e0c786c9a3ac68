"""Terms of a vocabulary that is as large as the texts, found where the texts are: only the vocabulary moves."""

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from demandlens.session import shared_dir, ship

# Bytes of texts that a task holds while it reads the vocabulary once, and terms that it holds at a time.
TEXT_BYTES, TERMS = 6 << 20, 1 << 18
# Bytes of texts whose words are told apart at a time, and pairs of text and term that are sorted at a time.
PIECE_BYTES, PAIRS = 1 << 21, 1 << 18


def readable(spark) -> bool:
    """Whether tasks can read the shared folder without Spark."""
    try:
        fs.FileSystem.from_uri(_uri(shared_dir(spark)))
    except (pa.ArrowInvalid, OSError, ValueError):
        return False
    return True


def _uri(path: str) -> str:
    return path if "://" in path else f"file://{path.removeprefix('file:')}"


def _open(uri: str):
    system, path = fs.FileSystem.from_uri(_uri(uri))
    return system.open_input_file(path)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each of ``starts`` on, ``sizes`` of each, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def _words(low: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, and of each text the numbers of its own distinct words, end to end, with how many they are."""
    coded, counts, ends = [], [], np.cumsum(pc.fill_null(pc.binary_length(low), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(ends // PIECE_BYTES, prepend=-1)).tolist()
    for first, last in zip(cuts, [*cuts[1:], len(low)]):
        # A null text is as one without words.
        text = pc.replace_substring(pc.fill_null(low.slice(first, last - first), b""), b"\n", b" ")
        words = pc.split_pattern(text, b" ")
        coded.append(words.flatten().dictionary_encode())
        counts.append(words.value_lengths().to_numpy())
    coded = pa.chunked_array(coded).unify_dictionaries()
    words, numbers = coded.chunk(0).dictionary, np.concatenate([c.indices.to_numpy() for c in coded.chunks])
    own = np.unique(np.repeat(np.arange(len(low)), np.concatenate(counts)) * max(len(words), 1) + numbers)
    return words, own % max(len(words), 1), np.bincount(own // max(len(words), 1), minlength=len(low))


def _held(words: pa.Array, files: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Spellings of the terms that occur in ``words``, by term in order, and of each word its terms, end to end, with how many they are."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    # How far a word goes on from each of its bytes.
    owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    left = np.repeat(offsets[1:], sizes)
    left -= np.arange(len(data))
    names, spellings, found, at = [], [], [], 0
    for uri in files:
        with _open(uri) as file:
            for batch in pq.ParquetFile(file).iter_batches(TERMS, columns=["_name", "skills"]):
                own = batch["_name"]
                lengths = pc.binary_length(own).to_numpy()
                for n in np.unique(lengths).tolist():
                    starts = np.flatnonzero(left >= n)
                    if not len(starts):
                        continue
                    of = np.flatnonzero(lengths == n)
                    terms = own.take(pa.array(of)).cast(pa.binary(n))
                    for begin in range(0, len(starts), max(1, PIECE_BYTES * 8 // n)):
                        part = starts[begin : begin + max(1, PIECE_BYTES * 8 // n)]
                        grams = np.lib.stride_tricks.sliding_window_view(data, n)[part]
                        grams = pa.FixedSizeBinaryArray.from_buffers(pa.binary(n), len(part), [None, pa.py_buffer(grams)])
                        met = pc.index_in(grams, value_set=terms)
                        there = pc.is_valid(met).to_numpy(zero_copy_only=False)
                        if not there.any():
                            continue
                        which, near = np.unique(of[met.drop_null().to_numpy()], return_inverse=True)
                        names.append(own.take(pa.array(which)))
                        spellings.append(batch["skills"].take(pa.array(which)))
                        found.append(np.stack([owner[part[there]], (near + at).astype(np.int32)]))
                        at += len(which)
    if not at:
        return pa.array([], pa.list_(pa.string())), np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    del owner, left, data, offsets
    names, spellings = pa.concat_arrays(names), pa.concat_arrays(spellings)
    # A term may have been met in several parts; terms are numbered by their bytes.
    order = pc.sort_indices(names).to_numpy()
    ordered = names.take(pa.array(order))
    new = np.append(True, pc.not_equal(ordered[1:], ordered[:-1]).to_numpy(zero_copy_only=False))
    number = np.empty(at, np.int64)
    number[order] = np.cumsum(new) - 1
    spellings = spellings.take(pa.array(order[new]))
    pairs, at = np.empty(sum(f.shape[1] for f in found), np.int64), 0
    while found:
        word, term = found.pop()
        np.add(word.astype(np.int64) * len(spellings), number[term], out=pairs[at : at + len(word)])
        at += len(word)
    pairs.sort()
    own = pairs[np.append(True, pairs[1:] != pairs[:-1])]
    del pairs
    counts = np.bincount(own // len(spellings), minlength=len(words))
    own %= len(spellings)
    return spellings, own, counts


def _runs(batches, at: int, size: int):
    """Rows of ``batches``, in lists of slices with about ``size`` bytes of column ``at``, or one row with more."""
    held, total = [], 0
    for batch in batches:
        # A row counts even if its text is null or empty.
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        first = 0
        while first < batch.num_rows:
            before = int(ends[first - 1]) if first else 0
            last = min(max(int(np.searchsorted(ends, before + size - total, side="right")), first + 1), batch.num_rows)
            held.append(batch.slice(first, last - first))
            total += int(ends[last - 1]) - before
            # A slice keeps its whole batch, so only small ones wait for the next.
            if last < batch.num_rows or total >= size // 4:
                yield held
                held, total = [], 0
            first = last
    if held:
        yield held


def _found(low: pa.Array, files: list[str]):
    """Of texts in a row, their number and the list of the spellings of each; first texts first."""
    words, numbers, counts = _words(low)
    spellings, terms, sizes = _held(words, files)
    starts, many, flat = np.cumsum(sizes) - sizes, spellings.value_lengths().to_numpy(), spellings.flatten()
    first_of, ends = np.cumsum(many) - many, np.cumsum(counts)
    pairs = np.bincount(np.repeat(np.arange(len(low)), counts), weights=sizes[numbers], minlength=len(low))
    cuts = np.flatnonzero(np.diff(np.cumsum(pairs) // PAIRS, prepend=-1)).tolist()
    for first, last in zip(cuts, [*cuts[1:], len(low)]):
        own = numbers[ends[first] - counts[first] : ends[last - 1]]
        text = np.repeat(np.repeat(np.arange(last - first), counts[first:last]), sizes[own])
        each = np.unique(text * max(len(spellings), 1) + terms[_ragged(starts[own], sizes[own])])
        text, term = each // max(len(spellings), 1), each % max(len(spellings), 1)
        lengths = np.bincount(text, weights=many[term], minlength=last - first).astype(np.int32)
        skills = flat.take(pa.array(_ragged(first_of[term], many[term])))
        yield last - first, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), skills)


def in_words(cvs: DataFrame, names: DataFrame, text_col: str, n_names: int) -> DataFrame:
    """Add ``skills``, in order: the spellings of the ``names`` (none has a blank) that occur in the words of each text.

    The names are written once, sorted by their length, and every task reads them all for each ``TEXT_BYTES`` of its texts: no text
    or word moves.  Columns are passed on through Arrow.
    """
    spark = ship(cvs.sparkSession)
    size = F.octet_length("_name")
    dealt = names.select("_name", "skills").repartitionByRange(-(-n_names // TERMS), size, F.crc32("_name")).sortWithinPartitions(size)
    path = f"{shared_dir(spark).rstrip('/')}/skill-names-{uuid.uuid4().hex}"
    dealt.write.option("compression", "zstd").parquet(path)
    files = sorted(spark.read.parquet(path).inputFiles())
    others = [c for c in cvs.columns if c != "skills"]

    def find(batches):
        for held in _runs(batches, len(others), TEXT_BYTES):
            at = 0
            table = pa.Table.from_batches([b.select(range(len(others))) for b in held])
            for n, skills in _found(pa.concat_arrays([b.column(len(others)) for b in held]), files):
                columns = [c.combine_chunks() for c in table.slice(at, n).columns]
                columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
                yield pa.RecordBatch.from_arrays([*columns, skills], names=[*others, "skills"])
                at += n
            pa.default_memory_pool().release_unused()

    schema = StructType([*cvs.select(*others).schema, StructField("skills", ArrayType(StringType()))])
    return cvs.select(*others, F.lower(text_col).cast("binary").alias("_low")).mapInArrow(find, schema)
