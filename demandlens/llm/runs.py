"""Periodic runs of words by seed and extend over diagonals.

Words at a distance of ``q`` that agree lie on the diagonal of lag ``q``.  A run of period ``q`` is a stretch of that
diagonal, at least ``max(q, min_length - q)`` words long: the overlap that a run has with itself for certain.
Lags are searched by octaves.  In each, every stretch holds a gram of a fixed share of the least overlap, starting at
a multiple of ``step``, so only those starts look up where their gram occurs again, and only as far away as
the octave's lags reach.  Occurrences of a gram are as far apart as its period at least, so an octave has at most two
pairs for each word whatever the text, also if one word is repeated a million times.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import BLANK_RUN
from demandlens.session import ship

MIN_LENGTH = 12
#: Words that are searched together; a text with more is searched by itself.
WORDS = 1 << 18


def octave(lo: int, min_length: int) -> tuple[int, int, int]:
    """For lags from ``lo`` to ``2 * lo - 1``: the least overlap, the seeds' words (a power of two) and their step."""
    hi = 2 * lo - 1
    overlap = min(max(min_length - q, q) for q in {lo, hi, *(min(max(x, lo), hi) for x in (min_length // 2, (min_length + 1) // 2))})
    gram = 1 << max(0, (2 * overlap // 3).bit_length() - 1)
    return overlap, gram, max(1, min(overlap - gram + 1, gram))


class Grams:
    """Numbers of the grams of 1, 2, 4, ... words at each place: equal numbers are equal grams.

    A gram that occurs once has a negative number of its own.  Longer grams are numbered from the halves, and only
    where both halves occur again.
    """

    def __init__(self, words: np.ndarray):
        self.tables, self.repeated = [], []
        self._add(words, np.ones(len(words), bool))

    def _add(self, keys: np.ndarray, where: np.ndarray) -> None:
        table = -1 - np.arange(len(keys))
        at = np.flatnonzero(where)
        numbers = pd.factorize(keys[at])[0]
        again = np.bincount(numbers, minlength=1)[numbers] > 1
        table[at[again]] = numbers[again]
        self.tables.append(table)
        self.repeated.append(at[again])

    def reach(self, power: int) -> bool:
        """Number grams up to ``2 ** power`` words; whether any of that size occurs again."""
        while len(self.tables) <= power and len(self.repeated[-1]):
            half, last = 1 << (len(self.tables) - 1), self.tables[-1]
            left, right = last[: max(0, len(last) - half)], last[half:]
            self._add(left * np.int64(len(last) + 1) + right, (left >= 0) & (right >= 0))
        return len(self.tables) > power and len(self.repeated[power]) > 0

    def equal(self, power: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the grams of ``2 ** power`` words at ``left`` and at ``right`` (further on) are equal."""
        table = self.tables[power]
        inside = (left >= 0) & (right < len(table))
        return inside & (table[np.where(inside, left, 0)] == table[np.where(inside, right, 0)]) if len(table) else inside


def seeds(grams: Grams, lo: int, power: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of occurrences of a gram, ``lo`` to ``2 * lo - 1`` words apart: the first's place (a multiple of step) and the lag."""
    at, n = grams.repeated[power], len(grams.tables[0]) + 1
    table = grams.tables[power]
    listed = np.sort(table[at] * n + at)
    first = at[at % step == 0]
    base = table[first] * n
    begin = np.searchsorted(listed, base + np.minimum(first + lo, n - 1))
    end = np.searchsorted(listed, base + np.minimum(first + 2 * lo, n - 1))
    found = end - begin
    place = np.arange(found.sum()) + np.repeat(begin - np.cumsum(found) + found, found)
    first = np.repeat(first, found)
    return first, listed[place] % n - first


def find_runs(words: np.ndarray, min_length: int = MIN_LENGTH, longest: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs of a sequence of numbers, by start and period.

    A run is a stretch with smallest period ``q`` and a length of at least ``max(min_length, 2 * q)`` that keeps the
    period with no neighbour added.  ``longest`` bounds the length of any run.  Takes memory for a number for each word and octave
    up to the longest that has repeated grams.
    """
    grams, found = Grams(np.asarray(words)), []
    lo, longest = 1, min(longest or len(words), len(words))
    while 2 * lo <= longest:
        _, size, step = octave(lo, min_length)
        power = size.bit_length() - 1
        reached = grams.reach(power)
        first, lag = seeds(grams, lo, power, step) if reached else (np.zeros(0, np.int64),) * 2
        lo *= 2
        if not len(first):
            continue
        order = np.lexsort((first, lag))
        first, lag = first[order], lag[order]
        # The furthest place covered on each lag: a seed that starts inside moves it on, any other opens a stretch.
        opens = np.ones(len(first), bool)
        opens[1:] = (lag[1:] != lag[:-1]) | (first[1:] - first[:-1] > step)
        closes = np.append(opens[1:], True)[: len(first)]
        left, right, lag = first[opens], first[closes] + size, lag[opens]
        # Neither end can move by a step, or a seed would be there: one test for each power of two below it.
        for p in reversed(range((step - 1).bit_length())):
            back = left - (1 << p)
            left = np.where(grams.equal(p, back, back + lag), back, left)
            right = right + (grams.equal(p, right, right + lag).astype(np.int64) << p)
        held = right - left >= np.maximum(min_length - lag, lag)
        found.append(np.stack([left, right + lag, lag], 1)[held])
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    # A stretch that is found under multiples of its period too has its smallest one first.
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[new]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs[:, 0], runs[:, 1] - runs[:, 0], runs[:, 2]


def search(texts: list[list[bytes]], min_length: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """Runs (rows of start, length, period) and kept words of each of several texts, searched together."""
    sizes = np.array([len(words) for words in texts], np.int64)
    ends = np.cumsum(sizes)
    own = np.repeat(np.arange(len(texts)), sizes)
    every = np.empty(len(own), object)
    every[:] = [word for words in texts for word in words]
    numbers, kinds = pd.factorize(every)
    # Words of different texts count as different, so no gram leaves its text.
    start, length, period = find_runs(own * np.int64(len(kinds) + 1) + numbers, min_length, int(sizes.max(initial=0)))
    depth = np.zeros(len(own) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    kept = np.cumsum(depth)[:-1] == 0
    cuts = np.searchsorted(start, ends)
    for i, words in enumerate(texts):
        begin = ends[i] - sizes[i]
        rows = slice(cuts[i - 1] if i else 0, cuts[i])
        runs = np.stack([start[rows] - begin, length[rows], period[rows]], 1)
        if len(runs):
            words = [w for w, k in zip(words, kept[begin : ends[i]], strict=True) if k]
        yield runs, b" ".join(words)


def collapse_runs(docs: DataFrame, id_col="doc_id", text_col="text", min_length: int = MIN_LENGTH) -> DataFrame:
    """Rows ``id, n_words, runs, collapsed`` of every document.

    Words are what ASCII white space separates.  ``runs`` are all stretches of words with smallest period ``q``, at least
    ``max(min_length, 2 * q)`` words long, that no neighbouring word extends: ``start``, ``length`` and
    ``period``, by start and period.  ``collapsed`` joins by one space the words that stay: of each run those of its first
    period, unless another run drops them.

    A null, empty or blank text has no words, no runs and an empty ``collapsed``; a null id stays null; repeated rows and
    ids are each searched by themselves; an empty table gives an empty one.  Other columns are left out.  Rows
    are searched where they are, nothing is shuffled, and a lost task repeats its own rows only.  Whole texts are searched; a
    text of n words that repeats itself all over takes some ``8 * n * log2(n)`` bytes, any other a few times ``8 * n``.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").cast("binary").alias("_text"))
    runs_type = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))

    def told(ids, found) -> pa.RecordBatch:
        runs = np.concatenate([r for r, _, _ in found])
        ends = np.cumsum([0] + [len(r) for r, _, _ in found])
        fields = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in runs.T], fields=list(runs_type.value_type))
        return pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array([n for _, n, _ in found], pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields, type=runs_type),
                pa.array([text for _, _, text in found], pa.binary()),
            ],
            names=["_id", "n_words", "runs", "_collapsed"],
        )

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, size, begin = [], 0, 0
            for i, text in enumerate(batch.column(1)):
                texts.append((text.as_py() or b"").split())
                size += len(texts[-1])
                if size >= WORDS or i == batch.num_rows - 1:
                    found = [(runs, len(words), kept) for (runs, kept), words in zip(search(texts, min_length), texts, strict=True)]
                    yield told(batch.column(0).slice(begin, len(texts)), found)
                    texts, size, begin = [], 0, i + 1

    kind = "array<struct<start: bigint, length: bigint, period: bigint>>"
    found = rows.mapInArrow(searched, f"_id {dict(rows.dtypes)['_id']}, n_words long, runs {kind}, _collapsed binary")
    return found.select(F.col("_id").alias(id_col), "n_words", "runs", F.col("_collapsed").cast("string").alias("collapsed"))


def longest_run(runs: Column) -> Column:
    """The run with the greatest length, of several the one that starts first, then that of the smallest period; null without runs."""
    key = F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("lag")))
    best = F.array_max(key)
    run = F.struct((-best["back"]).alias("start"), best["length"].alias("length"), (-best["lag"]).alias("period"))
    return F.when(F.size(runs) > 0, run)


def runs_text(runs: Column) -> Column:
    """A line ``start,length,period`` for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def with_planted_runs(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` where every tenth text, by its id's checksum, repeats a stretch of itself to its end.

    With ``h`` the CRC-32 of the id as text (a null id counts as an empty one) and ``g = h // 10``, a text of ``n``
    words with ``h % 10 = 0`` goes on from word ``a = g % n`` by repeating the ``1 + (n - a) // (3 + g % 8)`` words from there.
    """
    h = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), BLANK_RUN), lambda w: w != "")

    def repeated(words):
        n = F.greatest(F.size(words).cast("long"), F.lit(1))
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + F.pmod(i - a, p)).cast("int"))))

    # One array that both the words and their places are taken from.
    joined = F.transform(F.array(words), lambda own: F.array_join(repeated(own), " "))[0]
    return docs.withColumn(text_col, F.when(F.pmod(h, F.lit(10)) == 0, joined).otherwise(F.col(text_col).cast("string")))
