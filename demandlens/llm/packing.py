"""Packing documents into sequences by linear grouping, few-size configurations and best fit.

Lengths are whole numbers up to the capacity, so all that planning needs is how many pieces have each length.
That table has at most ``capacity`` rows whatever the corpus; the driver plans with it, and the tasks then look
up where the n-th piece of a length goes.
"""

import json
import os
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import numbered, written
from demandlens.session import ship

CAPACITY = 1024
END = 2
#: Lengths above this share of the capacity are large.
LARGE = 1 / 4
#: Groups of equal cardinality into which large pieces are dealt.
GROUPS = 48
#: A sequence whose last place leaves a gap of up to this part of the capacity is not made from a configuration.
GAP = 64
PIECES = "piece int, start long, length long, ids_crc32 long"


#: Fixed value: how byte-level tokenizers split a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of these characters only are split alike by whatever knows letters, digits and white space; and not by a huge run of white space.
PLAIN = re.compile("[\t\n\r\x20-\x7e\u00a1-\u017f\u2010-\u2027\u2030-\u205e\u20ac]*")
LONG_SPACE = re.compile(r"\s{1000}")


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from 256 on."""
    prints = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(others)}


def merge_ranks(spec: dict) -> dict[bytes, int] | None:
    """The tokens of a byte-level tokenizer's file by their bytes, if merges come in the order of their ids; else None."""
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if not (
        split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        and not spec.get("normalizer") and model["type"] == "BPE" and not model.get("ignore_merges")
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    ):
        return None
    byte, vocabulary = byte_characters(), model["vocab"]
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if not set(byte) <= set(vocabulary) or [vocabulary.get(m) for m in merged] != list(range(256, 256 + len(merged))):
        return None
    return {bytes(byte[c] for c in token): vocabulary[token] for token in [*byte, *merged]}


@lru_cache(maxsize=4)
def text_encoder(path: str):
    """A function from a text to its packed ids by the tokenizer of a file, one in each Python worker.

    A byte-level file whose ids are ranks (`merge_ranks`) is also run by the faster of two public engines, for texts that
    both split alike; all other texts and files by the tokenizer itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # strings of special tokens in a text are ordinary text

    def encode(text):
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() if text else b""

    with open(path, encoding="utf-8") as file:
        ranks = merge_ranks(json.load(file))
    if ranks is None:
        return encode
    engine = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def fast(text):
        if not PLAIN.fullmatch(text) or LONG_SPACE.search(text):
            return encode(text)
        return np.array(engine.encode_ordinary(text), "<u4").tobytes()

    return fast


def pieces(docs: DataFrame, path: str, capacity=CAPACITY, end=END, keep_ids=False, id_col="doc_id", text_col="text") -> DataFrame:
    """Every document's ids and the end id, cut into pieces: ``id, piece, start, length, ids_crc32[, ids]``.

    Only documents longer than ``capacity`` are cut; then the first piece takes the remainder.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    fields = PIECES + (", ids binary" if keep_ids else "")
    names = [id_col, *[f.split()[0] for f in fields.split(", ")]]
    last = np.array([end], "<u4").tobytes()

    def cut(batches):
        encode = text_encoder(path)
        for batch in batches:
            rows = []
            for key, text in zip(batch["_id"].to_numpy(object), batch["_text"], strict=True):
                ids = encode(text or "") + last
                total = len(ids) // 4
                edges = [0, *range(total % capacity or capacity, total, capacity), total]
                for i, (a, b) in enumerate(zip(edges, edges[1:])):
                    own = ids[4 * a : 4 * b]
                    rows.append((key, i, a, b - a, zlib.crc32(own), *([own] if keep_ids else [])))
            yield pd.DataFrame(rows, columns=names)

    ship(docs.sparkSession)
    text = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return text.mapInPandas(cut, f"{id_col} string, {fields}").withColumn(id_col, F.col(id_col).cast(id_type))


def linear_groups(counts: dict[int, int], groups: int) -> list[tuple[int, int]]:
    """Lengths in order, dealt into groups of equal cardinality: ``(largest length, pieces)`` of each.

    A group ends with the length that fills it up; lengths are not torn apart, so there can be fewer groups.
    """
    total, out, seen, held = sum(counts.values()), [], 0, 0
    for length in sorted(counts):
        held += counts[length]
        seen += counts[length]
        if held * groups >= total or seen == total:
            out.append((length, held))
            held = 0
    return out


def _best_configuration(sizes, worth, capacity):
    """The multiset of sizes that is worth most in one sequence, by dynamic programming."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        fit = sizes <= room
        gain = best[room - sizes[fit]] + worth[fit]
        k = int(gain.argmax())
        if gain[k] > best[room - 1] + 1e-12:
            best[room], pick[room] = gain[k], np.flatnonzero(fit)[k]
        else:
            best[room] = best[room - 1]
    room, used = capacity, Counter()
    while room > 0:
        if pick[room] < 0:
            room -= 1
            continue
        used[int(pick[room])] += 1
        room -= int(sizes[pick[room]])
    return best[capacity], used


def configurations(grouped: list[tuple[int, int]], capacity=CAPACITY, rounds=4000) -> list[tuple[Counter, int]]:
    """Configurations of the grouped sizes and how often each is used, few sizes at a time.

    Solves the linear program "least sequences that hold all pieces" by column generation: a basis of as many
    configurations as there are groups; the configuration worth most at the current prices enters until none is
    worth more than a sequence.  Uses are rounded down, so what is left is a few pieces of each group.
    """
    if not grouped:
        return []
    sizes, need = np.array([g[0] for g in grouped]), np.array([g[1] for g in grouped], float)
    basis = [Counter({i: int(capacity // s)}) for i, s in enumerate(sizes)]
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    uses = inverse @ need
    for _ in range(rounds):
        value, column = _best_configuration(sizes, inverse.sum(0), capacity)
        if value <= 1 + 1e-7:
            break
        enter = np.zeros(len(sizes))
        for i, n in column.items():
            enter[i] = n
        step = inverse @ enter
        ratio = np.where(step > 1e-10, uses / np.where(step > 1e-10, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        uses = np.maximum(uses - ratio[out] * step, 0)
        uses[out] = ratio[out]
        inverse[out] /= step[out]
        others = np.arange(len(sizes)) != out
        inverse[others] -= np.outer(step[others], inverse[out])
        basis[out] = column
    return [(column, int(n + 1e-6)) for column, n in zip(basis, uses, strict=True) if n + 1e-6 >= 1]


def plan(counts: dict[int, int], capacity=CAPACITY, large=LARGE, groups=GROUPS) -> list[tuple[tuple[int, ...], int]]:
    """How to pack so many pieces of each length: ``(lengths in one sequence, sequences like it)``.

    Large lengths are rounded up to the largest of their group and arranged by `configurations`.  Then real
    lengths take the places, the longest of the group first; as they are shorter than what they were rounded to,
    the last place of a sequence takes the longest that still fits.  What is left of large ones, and all small
    ones, go where they fit best, longest first.  Sequences with the same lengths are handled as one, so the
    work depends on the number of different lengths and not on the corpus.
    """
    big = {n: c for n, c in counts.items() if capacity * large < n < capacity}
    left, lengths, shapes, tops = dict(big), sorted(big), Counter(), []
    grouped = linear_groups(big, groups)
    tops = [top for top, _ in grouped]

    def take(room, least, used):
        """The longest length up to ``room`` that there is more of than ``used``, if it is over ``least``."""
        at = bisect_right(lengths, room) - 1
        while at >= 0 and lengths[at] > least:
            if left[lengths[at]] > used[lengths[at]]:
                return lengths[at]
            at -= 1
        return None

    for column, times in configurations(grouped, capacity):
        places = sorted((i for i, n in column.items() for _ in range(n)), reverse=True)
        while times:
            used, room = Counter(), capacity
            for k, i in enumerate(places):
                last = k + 1 == len(places)
                length = take(room if last else tops[i], tops[i - 1] if i else 0, used)
                if length is None:
                    break
                used[length] += 1
                room -= length
            if used.total() < len(places) or 0 < room * GAP <= capacity:
                break  # a group has run out, or leaves a gap that little fits into; what is left is packed below
            run = min([times, *(left[n] // k for n, k in used.items())])
            for n, k in used.items():
                left[n] -= k * run
                if not left[n]:
                    lengths.remove(n)
            shapes[tuple(sorted(used.elements(), reverse=True))] += run
            times -= run
    rest = {n: c for n, c in counts.items() if n not in big and n < capacity}
    best_fit(shapes, rest | {n: c for n, c in left.items() if c}, capacity)
    if counts.get(capacity):
        shapes[(capacity,)] += counts[capacity]
    return sorted(shapes.items(), reverse=True)


def best_fit(shapes: Counter, rest: dict[int, int], capacity=CAPACITY):
    """Put so many pieces of each length, longest first, where the least room is left; in new sequences where none fits."""
    by_room = defaultdict(Counter)
    for shape, n in shapes.items():
        by_room[capacity - sum(shape)][shape] += n
    rooms = sorted(by_room)
    for length in sorted(rest, reverse=True):
        left = rest[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                shape, n = ((length,) * each, left // each) if left >= each else ((length,) * left, 1)
                left -= len(shape) * n
            else:
                room = rooms[at]
                old = next(iter(by_room[room]))
                n = min(left, by_room[room][old])
                by_room[room][old] -= n
                if not by_room[room][old]:
                    del by_room[room][old]
                    if not by_room[room]:
                        del rooms[at]
                left -= n
                shape = (*old, length)
            room = capacity - sum(shape)
            if not by_room[room]:
                rooms.insert(bisect_left(rooms, room), room)
            by_room[room][shape] += n
    shapes.clear()
    for held in by_room.values():
        shapes.update(held)


def _places(shapes) -> pd.DataFrame:
    """Where pieces of each length go: from the ``first``-th on, ``offset`` in sequences from ``sequence`` on."""
    seen, rows, sequence = Counter(), [], 0
    for shape, n in shapes:
        offset = 0
        for length in shape:
            rows.append((length, seen[length], sequence, offset))
            seen[length] += n
            offset += length
        sequence += n
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"]).sort_values(["length", "first"])


def pack(
    docs: DataFrame, path: str, capacity=CAPACITY, end=END, large=LARGE, groups=GROUPS, keep_ids=False, id_col="doc_id", text_col="text"
) -> DataFrame:
    """Every piece with its place: ``id, piece, start, length, ids_crc32[, ids], sequence_id, offset``.

    ``path`` is a tokenizer's file that every executor can read.  A null or empty text is its end id alone.
    Rows that repeat an id are packed as documents of their own.  An empty table gives no rows; other columns
    are left out.  With ``keep_ids`` each piece carries its ids, packed; sorting a sequence's pieces by
    ``offset`` gives the sequence without gaps.

    Texts are read once and not moved.  Pieces are numbered within their length, in parts that stay small
    (`numbered`), and the n-th piece of a length takes the n-th place that `plan` has for it.  The table of places
    depends on the lengths only: at most a few thousand shapes.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, path, capacity, end, keep_ids, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = _places(plan(counts, capacity, large, groups))
    keys = (places["length"].to_numpy("int64") << 44) + places["first"].to_numpy("int64")
    first, sequence, offset = (places[c].to_numpy("int64") for c in ("first", "sequence", "offset"))

    def place(batches):
        for batch in batches:
            at = np.searchsorted(keys, (batch["length"].to_numpy("int64") << 44) + batch["_nth"].to_numpy("int64"), "right") - 1
            batch["sequence_id"] = sequence[at] + batch["_nth"].to_numpy("int64") - first[at]
            batch["offset"] = offset[at]
            yield batch.drop(columns="_nth")

    ship(spark)
    nth = numbered(cut, "length", [id_col, "piece", "ids_crc32"], "_nth")
    kind = dict(cut.dtypes)[id_col]
    nth = nth.select(F.col(id_col).cast("string").alias(id_col), *cut.columns[1:], "_nth")
    schema = ", ".join(f"{name} {'string' if name == id_col else kind}" for name, kind in cut.dtypes)
    placed = nth.mapInPandas(place, f"{schema}, sequence_id long, offset long")
    return placed.withColumn(id_col, F.col(id_col).cast(kind))
