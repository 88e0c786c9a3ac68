"""Language-model scores of documents: unigram counts of all training documents, and a gated recurrent network."""

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demandlens.llm.common import removed, scratch, written
from demandlens.llm.gru import CLASSES, OTHERS, UNITS, WORDS, Gru
from demandlens.llm.quality import fold
from demandlens.session import ship

#: Tokens of a chunk: documents whose words are numbered together.
CHUNK_TOKENS = 1 << 21
#: Bytes of text that are taken apart at a time.
TEXT_BYTES = 1 << 22
#: A row of chunks or lessons has megabytes, so a row group is closed once it has so many bytes and not after a hundred rows
#: at the earliest.  Writers and readers hold one at a time, however much a task has.
SHORT_GROUPS = {"parquet.block.size": 1 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
#: Parts of the training documents.  The network is trained on all of them, one in each round.
PARTS = 4
#: Slices in which trained weights are averaged.
WEIGHT_SLICES = 64
CHUNKS = (
    "chunk long, ids array<string>, held array<boolean>, part array<int>, sizes array<long>, tokens binary, "
    "words string, counts binary"
)
SCORES = (
    "{id} string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def numbered_words(docs: DataFrame) -> DataFrame:
    """Documents (``_id, _text, _held, _part``) as chunks: token numbers, and the words that the numbers stand for.

    A-Z count as a-z, words are parted by ASCII white space, and the empty word ends a document.  ``words`` has the
    words with blanks between them, as they hold none; ``counts`` how often training documents hold each, as 64-bit numbers.  A chunk is closed when it has ``CHUNK_TOKENS``, so only a longer
    document makes a larger one.
    """

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0

        def close(pieces):
            """One chunk of ``pieces``: words end to end, their number in each document, and the documents."""
            coded = pa.chunked_array([p[0] for p in pieces]).unify_dictionaries()
            sizes, meta = np.concatenate([p[1] for p in pieces]), pa.Table.from_batches([p[2] for p in pieces]).combine_chunks()
            held = meta["_held"].to_numpy()
            # An end, which is word 0, follows the words of each document.
            sizes = sizes + 1
            flat, inner = np.zeros(int(sizes.sum()), "<u4"), np.ones(int(sizes.sum()), bool)
            inner[np.cumsum(sizes) - 1] = False
            flat[inner] = np.concatenate([c.indices.to_numpy() for c in coded.chunks]) + 1
            words = pa.concat_arrays([pa.array([""]), coded.chunk(0).dictionary])
            counts = np.bincount(flat[np.repeat(~held, sizes)], minlength=len(words))
            joined = pc.binary_join(_as_list(words), " ")
            row = {
                "chunk": pa.array([task << 32 | number]),
                "ids": _as_list(meta["_id"]),
                "held": _as_list(meta["_held"]),
                "part": _as_list(meta["_part"]),
                "sizes": _as_list(pa.array(sizes)),
                "tokens": pa.array([flat.tobytes()]),
                "words": joined,
                "counts": pa.array([counts.astype("<i8").tobytes()]),
            }
            return pa.RecordBatch.from_pydict(row)

        pieces, held_tokens = [], 0
        for batch in _bounded(batches, "_text", TEXT_BYTES):
            text = pc.fill_null(batch["_text"].cast(pa.string()), "")
            text = pc.ascii_trim_whitespace(pc.ascii_lower(text))
            words = pc.ascii_split_whitespace(text)
            # A text without words has one empty word.
            sizes = np.where(pc.equal(text, ""), 0, words.value_lengths()).astype(np.int64)
            flat = words.flatten()
            flat = flat.filter(pc.not_equal(flat, ""))
            ends, first = np.cumsum(sizes), 0
            while first < len(sizes):
                before = int(ends[first - 1]) if first else 0
                # The document with which the chunk is full, counting ends.
                tokens = held_tokens + ends[first:] - before + np.arange(1, len(sizes) - first + 1)
                full = int(np.searchsorted(tokens, CHUNK_TOKENS))
                last = min(first + full + 1, len(sizes))
                # What is kept is numbers and copies: nothing that the batch's texts stay for.
                piece = flat.slice(before, int(ends[last - 1]) - before).dictionary_encode()
                pieces.append((piece, sizes[first:last], batch.select(["_id", "_held", "_part"]).take(pa.array(range(first, last)))))
                held_tokens = int(tokens[last - first - 1])
                if held_tokens >= CHUNK_TOKENS:
                    yield close(pieces)
                    pieces, held_tokens, number = [], 0, number + 1
                    pa.default_memory_pool().release_unused()
                first = last
        if pieces:
            yield close(pieces)

    return docs.mapInArrow(run, CHUNKS)


def _bounded(batches, column: str, size: int):
    """The rows of ``batches`` in slices with about ``size`` bytes of ``column``, or one row with more."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths, dtype=np.int64) // size
        edges = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
        for first, last in zip(edges, edges[1:]):
            yield batch.slice(first, last - first)


def _as_list(values) -> pa.Array:
    """One list of all ``values``."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def counted(chunks: DataFrame) -> DataFrame:
    """``chunk, at, count, word``: the training count of every word of every chunk; ``word`` in one chunk only.

    Each chunk sends each of its words once, so the most frequent word comes once from each.
    """

    def listed(batches):
        for batch in batches:
            for chunk, words, counts in zip(*(batch[c] for c in ("chunk", "words", "counts")), strict=True):
                words = _apart(words)
                row = {
                    "chunk": pa.repeat(chunk, len(words)),
                    "at": pa.array(np.arange(len(words), dtype=np.int32)),
                    "word": words,
                    "count": pa.array(np.frombuffer(counts.as_buffer(), "<i8")),
                }
                yield pa.RecordBatch.from_pydict(row)

    rows = chunks.select("chunk", "words", "counts").mapInArrow(listed, "chunk long, at int, word string, count long")
    same = Window.partitionBy("word")
    home = F.min("chunk").over(same) == F.col("chunk")
    return rows.select("chunk", "at", F.sum("count").over(same).alias("count"), F.when(home, F.col("word")).alias("word"))


def _apart(words: pa.Scalar) -> pa.Array:
    """The words of a chunk."""
    return pc.split_pattern(pa.array([words.as_py()], pa.string()), " ").flatten()


def _network_ids(words: pa.Array, known: list[str], others: int) -> np.ndarray:
    """The network's numbers of words: those after the known ones are the classes that others are hashed to."""
    ids = pc.fill_null(pc.index_in(words, value_set=pa.array(known, pa.string())), -1).to_numpy().astype(np.int64)
    rest = words.filter(pa.array(ids < 0)).cast(pa.binary()).to_pylist()
    ids[ids < 0] = len(known) + np.fromiter(map(zlib.crc32, rest), np.int64, len(rest)) % others
    return ids


def train(chunks: DataFrame, known: list[str], model: Gru, rounds=PARTS, others=OTHERS) -> Gru:
    """Train the network once on every training document, in rounds: those of part 0, part 1 and so on.

    In a round every task starts from the same weights and learns from its chunks' documents by truncated
    backpropagation; then the weights are averaged, each with as much weight as it saw tokens.  Tasks send the
    mean difference from the weights they started with, in half precision (rounded by one part in 2,048 of what a round
    changes); only the averaged differences, of a fixed size, reach the driver.
    """

    def lessons(batches):
        for batch in batches:
            for chunk, held, part, sizes, tokens, words in zip(*batch.columns, strict=True):
                ids = _network_ids(_apart(words), known, others).astype("<u2")[np.frombuffer(tokens.as_buffer(), "<u4")]
                held, part, sizes = (x.values.to_numpy(zero_copy_only=False) for x in (held, part, sizes))
                documents = np.split(ids, np.cumsum(sizes)[:-1])
                for r in range(rounds):
                    own = [documents[d] for d in np.flatnonzero((part == r) & ~held)]
                    if own:
                        row = {"chunk": [chunk.as_py()], "round": pa.array([r], pa.int32()), "tokens": [np.concatenate(own).tobytes()]}
                        yield pa.RecordBatch.from_pydict(row)

    needed = chunks.select("chunk", "held", "part", "sizes", "tokens", "words")
    folder = scratch(chunks.sparkSession, "lm-lessons")
    texts = written(needed.mapInArrow(lessons, "chunk long, round int, tokens binary"), "lm-lessons", "zstd", folder, **SHORT_GROUPS)
    start = model.vector()

    def study(batches):
        total, weight = np.zeros(len(start)), 0
        for batch in batches:
            for packed in batch["tokens"]:
                tokens = np.frombuffer(packed, "<u2").astype(np.int64)
                documents = np.split(tokens, np.flatnonzero(tokens == 0)[:-1] + 1)
                model.load(sent.value)
                model.train(documents)
                total += (model.vector() - sent.value) * float(len(tokens))
                weight += len(tokens)
        if weight:
            parts = np.array_split((total / weight).astype("<f2"), WEIGHT_SLICES)
            yield pd.DataFrame({"slice": range(WEIGHT_SLICES), "weight": weight, "moved": [p.tobytes() for p in parts]})

    def average(key, group):
        each = zip(group["moved"], group["weight"], strict=True)
        total = sum(np.frombuffer(m, "<f2").astype(np.float64) * float(w) for m, w in each) / group["weight"].sum()
        return pd.DataFrame({"slice": [key[0]], "mean": [total.tobytes()]})

    for r in range(rounds):
        sent = chunks.sparkSession.sparkContext.broadcast(start)  # of the network's size
        sums = texts.filter(F.col("round") == r).mapInPandas(study, "slice int, weight long, moved binary")
        means = sums.groupBy("slice").applyInPandas(average, "slice int, mean binary").collect()
        if means:
            moved = np.concatenate([np.frombuffer(m["mean"]) for m in sorted(means, key=lambda m: m["slice"])])
            start = (start + moved).astype(np.float32)
    removed(chunks.sparkSession, folder)
    model.load(start)
    return model


def score(
    docs: DataFrame, folds=7, held=2, id_col="doc_id", text_col="text", words=WORDS, classes=CLASSES, units=UNITS, parts=PARTS, others=OTHERS
) -> DataFrame:
    """Rows ``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    Documents whose fold (`quality.fold`) is ``held`` are held out: nothing is learned from them.  ``base_score``
    sums ``log10((count + 1) / (N + V + 1))`` over the document's words and its end.  ``score`` is the log10
    probability of the whole document by the network; the ``words`` most frequent words have outputs of their own, and
    any other word has an output and an input row with those of the same hash (``others`` hashes), of which it takes its
    share by its count plus one.  The unknown is in the first of these.  Both sum to one over all words and one unknown.

    Null and empty texts are an end alone.  Rows that repeat an id are documents of their own.  Without training
    tokens both scores are the base.  An empty table gives an empty one.  Other columns are left out.

    Counts cover all training documents.  Texts are read once and turned into numbered chunks; then words move,
    once for each chunk, and chunks meet the counts of their own words.  No table of all words is ever in one place.
    The network learns from every training document once, in ``parts`` rounds; id and text tell a row's round.
    """
    spark = ship(docs.sparkSession)
    text = docs.select(
        F.col(id_col).cast("string").alias("_id"),
        F.col(text_col).cast("string").alias("_text"),
        (fold(id_col, folds) == held).alias("_held"),
        F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")), F.lit(parts)).cast("int").alias("_part"),
    )
    chunks = written(numbered_words(text), "lm-chunks", "zstd", **SHORT_GROUPS)
    looked = written(counted(chunks), "lm-counts", "zstd")
    own = looked.filter("word is not null and count > 0")
    total, kinds = own.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    # At most ``words`` rows: the network's vocabulary.
    common = own.filter("word != ''").orderBy(F.desc("count"), "word").select("word", "count").limit(words - 1).collect()
    ends = own.filter("word = ''").select("word", "count").collect()
    listed = [*ends, *common]
    known = [row["word"] for row in listed]
    everything = total + kinds + 1
    # What the other words of each hash have together; at most ``others`` rows.
    rest = np.zeros(others, np.int64)
    for row in own.groupBy((F.crc32(F.col("word").cast("binary")) % others).alias("at")).agg(F.sum(F.col("count") + 1).alias("n")).collect():
        rest[row["at"]] = row["n"]
    for row in listed:
        rest[zlib.crc32(row["word"].encode()) % others] -= row["count"] + 1
    rest[0] += 1
    model = None
    if listed:
        logs = np.log(np.array([row["count"] + 1 for row in listed]) / everything)
        with np.errstate(divide="ignore"):
            model = train(chunks, known, Gru(logs, np.log(rest / everything), units, classes), parts, others)

    names = [f.split()[0] for f in SCORES.format(id=id_col).split(", ")]

    def run(chunk, entries):
        row = {c: chunk[c][0] for c in chunk.column_names}
        words = _apart(row["words"])
        counts = np.zeros(len(words), np.int64)
        counts[entries["at"].to_numpy()] = entries["count"].to_numpy()
        tokens, sizes = np.frombuffer(row["tokens"].as_buffer(), "<u4"), row["sizes"].values.to_numpy()
        starts = np.cumsum(sizes) - sizes
        base = np.add.reduceat(np.log10((counts + 1) / everything)[tokens], starts)
        final = base
        if model is not None:
            ids = np.where(counts > 0, _network_ids(words, known, others), len(known)).astype(np.int32)
            shares = np.where(ids >= len(known), np.log((counts + 1) / np.maximum(rest, 1)[np.maximum(ids - len(known), 0)]), 0.0)
            found = model.score(np.split(ids[tokens], starts[1:]))
            final = (found + np.add.reduceat(shares[tokens], starts)) / np.log(10)
        n_known = np.add.reduceat((counts > 0).astype(np.int64)[tokens], starts)
        columns = (row["ids"].values, row["held"].values, sizes, n_known, np.full(len(sizes), total), base, final)
        return pa.table(dict(zip(names, columns, strict=True)))

    needed = chunks.select("chunk", "ids", "held", "sizes", "tokens", "words")
    scored = (
        needed.groupBy("chunk")
        .cogroup(looked.select("chunk", "at", "count").groupBy("chunk"))
        .applyInArrow(run, SCORES.format(id=id_col))
    )
    return scored.withColumn(id_col, F.col(id_col).cast(dict(docs.dtypes)[id_col]))
