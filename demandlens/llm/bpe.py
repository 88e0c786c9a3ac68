"""Byte-level BPE by tree reduction: halves are encoded by themselves, and neighbours are joined at their boundary."""

import base64
import hashlib
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.session import ship

#: Pieces whose encoding a worker remembers; it forgets all of them beyond that.
REMEMBERED = 500_000
#: Characters of text from which on pieces are searched and encoded a stretch at a time.
STRETCH = 1 << 20
#: A space that white space follows: there, a piece can begin before the last space of a run.
SPACE_RUN = re.compile(r" \s")
#: Bytes of a leaf of the tree.
LEAF = 12
#: Bytes up to which data is merged without a heap.
SHORT = 64
ENCODED = "ids binary, n_tokens long, decoded binary"


class TreeBpe:
    """Encodes and decodes with the merge ranks of a vocabulary (token bytes: id; a lower id merges first).

    Merging is a monoid on token lists: ``join(a, b)`` is the encoding of the bytes of both.  It keeps all of
    ``a`` and ``b`` but a window at their boundary, which is encoded anew and grows until it fits.  What fits is
    proved by pairs: a token list is the encoding of its bytes exactly if every two neighbours are the encoding
    of theirs.  Inside the window and inside what is kept that holds already; it remains to see it at the
    window's two edges.  The window grows to at most the whole, so joining always ends.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self._fits = {}
        self._pieces = {}

    def merge(self, data: bytes) -> list[int]:
        """The encoding by the definition: the pair with the lowest rank merges first, the leftmost of equals.

        Short data is searched for its lowest pair each time, longer data keeps its pairs in a heap.
        """
        if len(data) > SHORT:
            return self._merge_long(data)
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            known = [r for r in pairs if r is not None]
            if not known:
                return [ranks[p] for p in parts]
            i = pairs.index(min(known))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i])
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1])

    def _merge_long(self, data: bytes) -> list[int]:
        ranks, n = self.ranks, len(data)
        parts = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapify(heap)

        def offer(i):
            if i >= 0 and after[i] < n:
                pair = parts[i] + parts[after[i]]
                if (r := ranks.get(pair)) is not None:
                    heappush(heap, (r, i, len(pair)))

        while heap:
            _, i, size = heappop(heap)
            j = after[i]
            # A pair of old parts: one of them has merged meanwhile.
            if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i], parts[j] = parts[i] + parts[j], b""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [ranks[p] for p in parts if p]

    def fits(self, a: int, b: int) -> bool:
        """Whether the tokens ``a, b`` are the encoding of their bytes."""
        key = (a, b)
        found = self._fits.get(key)
        if found is None:
            if len(self._fits) >= REMEMBERED:
                self._fits.clear()
            found = self._fits[key] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return found

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of the bytes of ``a`` and ``b``, each an encoding itself."""
        if not a or not b or self.fits(a[-1], b[0]):
            return a + b
        tokens, left, right = self.tokens, 1, 1
        while True:
            lo, hi = len(a) - left, right
            data = b"".join([tokens[t] for t in a[lo:]] + [tokens[t] for t in b[:hi]])
            middle = self.merge(data)
            open_left = lo > 0 and not self.fits(a[lo - 1], middle[0])
            open_right = hi < len(b) and not self.fits(middle[-1], b[hi])
            if not open_left and not open_right:
                return a[:lo] + middle + b[hi:]
            if open_left:
                left = min(2 * left, len(a))
            if open_right:
                right = min(2 * right, len(b))

    def _halves(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.merge(data)
        middle = len(data) // 2
        return self.join(self._halves(data[:middle]), self._halves(data[middle:]))

    def encode(self, data: bytes) -> list[int]:
        """The ids of ``data`` as one piece."""
        return self._halves(data) if data else []

    def packed(self, piece: str) -> bytes:
        """The ids of a piece as little-endian unsigned 32-bit integers, remembered."""
        found = self._pieces.get(piece)
        if found is None:
            if len(self._pieces) >= REMEMBERED:
                self._pieces.clear()
            found = np.array(self.encode(piece.encode()), "<u4").tobytes()
            if len(piece) <= 64:
                self._pieces[piece] = found
        return found

    def decode(self, ids) -> bytes:
        """The bytes of ids, concatenated up a tree: short lists at once, longer ones by halves."""
        if len(ids) <= 1 << 16:
            return b"".join(map(self.tokens.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with lines of a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class WordCache(dict):
    """What ``encode`` gives for a word with a space before it; it forgets all words beyond ``most``.

    ``many``, if there is one, encodes several words at a time.
    """

    def __init__(self, encode, many=None, most=REMEMBERED):
        super().__init__()
        self.encode, self.many, self.most = encode, many, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        found = self.encode(" " + word)
        if len(word) <= 64:
            self[word] = found
        return found

    def learn(self, words):
        """Encode the words that are new."""
        new = [w for w in {*words} if w not in self and 0 < len(w) <= 64]
        if new:
            if len(self) + len(new) > self.most:
                self.clear()
            self.update(zip(new, self.many(new), strict=True))


def by_words(text: str, encode, words: WordCache) -> bytes:
    """``encode(text)``, put together from words where no piece can reach over the space between them.

    That holds for patterns whose pieces have a space only at their start or are all white space, such as
    ``public_tokenizers.PATTERN``: a piece ends before a space that follows something else, and it begins there
    if no more white space follows.
    """
    if SPACE_RUN.search(text):
        return encode(text)
    first, *rest = text.split(" ")
    if words.many:
        words.learn(rest)
    return b"".join([encode(first), *map(words.__getitem__, rest)])


@lru_cache(maxsize=4)
def encoder(path: str) -> TreeBpe:
    """The encoder of a rank file, one in each Python worker."""
    return TreeBpe(load_ranks(path))


@lru_cache(maxsize=4)
def text_encoder(path: str, pattern: str, spaced: bool):
    """A function from a text to its packed ids; ``spaced`` tells that `by_words` holds for the pattern."""
    bpe, pieces = encoder(path), regex.compile(pattern)

    def encode(text):
        if len(text) < STRETCH:
            return b"".join(map(bpe.packed, pieces.findall(text)))
        out, stretch, size = [], [], 0
        for found in pieces.finditer(text):
            stretch.append(bpe.packed(found.group()))
            size += len(stretch[-1])
            if size >= STRETCH:
                out.append(b"".join(stretch))
                stretch, size = [], 0
        return b"".join([*out, *stretch])

    words = WordCache(encode)
    return (lambda text: by_words(text, encode, words)) if spaced else encode


def _each(docs: DataFrame, path: str, pattern: str, spaced, id_col, text_col, fields: str, row) -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe, packed = encoder(path), text_encoder(path, pattern, spaced)
        for batch in batches:
            rows = []
            for text in batch["_text"]:
                ids = packed(text or "")
                rows.append(row(ids, bpe.decode(np.frombuffer(ids, "<u4"))))
            names = [f.split()[0] for f in fields.split(", ")]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, id_col, batch["_id"].to_numpy(object))  # as text, for a null among numbers would make them floats
            yield out

    ship(docs.sparkSession)
    text = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return text.mapInPandas(run, f"{id_col} string, {fields}").withColumn(id_col, F.col(id_col).cast(id_type))


def encode(docs: DataFrame, path: str, pattern: str, spaced=False, id_col="doc_id", text_col="text") -> DataFrame:
    """Rows ``id, ids, n_tokens, decoded``: each text's ids (packed, little-endian) and the bytes they decode to.

    ``path`` is a rank file that every executor can read.  Every match of ``pattern`` is encoded by itself, without
    special tokens; ``spaced`` takes a shorter way to the same ids for patterns that allow it (`by_words`).  A null or empty text has no ids.  Nothing is shuffled; repeated rows are each encoded;
    an empty table gives an empty one; other columns are left out.
    """
    return _each(docs, path, pattern, spaced, id_col, text_col, ENCODED, lambda ids, data: (ids, len(ids) // 4, data))


def encode_digests(docs: DataFrame, path: str, pattern: str, spaced=False, id_col="doc_id", text_col="text") -> DataFrame:
    """As `encode`, with digests in place of ids and bytes: ``id, n_tokens, ids_sha256, decoded_sha256``."""

    def row(ids, data):
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(data).hexdigest()

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _each(docs, path, pattern, spaced, id_col, text_col, fields, row)
