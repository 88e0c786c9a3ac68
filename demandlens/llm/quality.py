"""Quality of documents by a vote of their nearest labelled neighbours in a latent-semantic space."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import under_own_names, written
from demandlens.session import ship

#: The most labelled documents that the classifier is fitted on.
SAMPLE = 6000
#: Dimensions of the latent space, neighbours that vote, and the power of the similarity that weighs a vote.
DIMENSIONS, NEIGHBOURS, POWER = 48, 15, 32
#: Terms: hashed triples of character shapes, hashed pairs of bytes, and words that repeat the one before.
SHAPES, PAIRS, REPEATS = 4096, 4096, 1
TERMS = SHAPES + PAIRS + REPEATS
#: Bytes of a text that are counted at a time.
STRETCH = 1 << 20
BLOCK = 256


def _shapes() -> np.ndarray:
    """A byte's shape: letters by case and digits as one each, other ASCII as itself, bytes beyond it as one."""
    table = np.arange(256, dtype=np.int64)
    table[ord("a") : ord("z") + 1] = ord("a")
    table[ord("A") : ord("Z") + 1] = ord("A")
    table[ord("0") : ord("9") + 1] = ord("0")
    table[128:] = 128
    return table


SHAPE = _shapes()


def _hashed(codes: np.ndarray, buckets: int) -> np.ndarray:
    return (codes * 2654435761 >> 7) % buckets


def terms(text: str | None) -> np.ndarray:
    """How often each term occurs, as square roots of shares within its kind; zeros for an empty text.

    The whole text counts, a stretch at a time.
    """
    data = (text or "").encode()
    counts, words, repeated = np.zeros(SHAPES + PAIRS), 0, 0
    for at in range(0, len(data), STRETCH):
        raw = np.frombuffer(data, np.uint8, min(STRETCH + 2, len(data) - at), at)
        own = min(STRETCH, len(data) - at)  # terms that begin in this stretch
        shape, wide = SHAPE[raw], raw.astype(np.int64)
        if len(raw) > 2:
            triples = (shape[:-2] << 16 | shape[1:-1] << 8 | shape[2:])[:own]
            counts[:SHAPES] += np.bincount(_hashed(triples, SHAPES), minlength=SHAPES)
        if len(raw) > 1:
            pairs = (wide[:-1] << 8 | wide[1:])[:own]
            counts[SHAPES:] += np.bincount(_hashed(pairs, PAIRS), minlength=PAIRS)
    parts = data.split()
    words = len(parts)
    repeated = sum(map(bytes.__eq__, parts, parts[1:]))
    out = np.zeros(TERMS, np.float32)
    for lo, hi in ((0, SHAPES), (SHAPES, SHAPES + PAIRS)):
        total = counts[lo:hi].sum()
        if total:
            out[lo:hi] = np.sqrt(counts[lo:hi] / total)
    out[-1] = 2 * np.sqrt(repeated / words) if words else 0
    return out


def latent_space(matrix: np.ndarray, dimensions: int, seed=0) -> np.ndarray:
    """The leading right singular vectors of a document-term matrix, by randomised subspace iteration."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((matrix.shape[1], min(dimensions + 8, *matrix.shape))).astype(np.float32)
    for _ in range(5):
        base, _ = np.linalg.qr(matrix.T @ (matrix @ base))
    _, _, right = np.linalg.svd(matrix @ base, full_matrices=False)
    return (base @ right.T)[:, :dimensions].astype(np.float32)


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms > 0, norms, 1)


class Vote:
    """Labelled vectors in latent space; a document's score is the weighted share of its neighbours labelled 1."""

    def __init__(self, matrix: np.ndarray, labels: np.ndarray, dimensions=DIMENSIONS, neighbours=NEIGHBOURS, power=POWER):
        self.neighbours, self.power = neighbours, power
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float64)
        self.space = latent_space(matrix, dimensions) if len(labels) else np.zeros((TERMS, 0), np.float32)
        self.vectors = _unit(matrix @ self.space)

    def scores(self, matrix: np.ndarray) -> np.ndarray:
        """Scores of a block of documents: exact cosines with all labelled vectors, the nearest ones vote.

        Where no neighbour has a positive cosine, as for an empty text, the score is the share of label 1.
        """
        if not len(self.labels):
            return np.full(len(matrix), self.prior)
        cosines = _unit(matrix @ self.space) @ self.vectors.T
        k = min(self.neighbours, cosines.shape[1])
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weights = np.maximum(np.take_along_axis(cosines, near, 1).astype(np.float64), 0) ** self.power
        total = weights.sum(1)
        share = (weights * self.labels[near]).sum(1) / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 0, share, self.prior), 0, 1)


def fold(id_col, parts: int):
    """The remainder of the CRC-32 of the id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def fit(docs: DataFrame, labels: DataFrame, label_col="quality", id_col="doc_id", text_col="text", sample=SAMPLE) -> Vote:
    """Fit on the labelled ``docs``: at most ``sample`` of them, those whose ids have the smallest hashes.

    Labels other than 0 and 1, and null ids, are left out; of repeated labels of an id the smallest counts, of its
    repeated rows that whose text has the smallest hash.
    The texts become terms inside tasks, and only terms of the bounded sample reach the driver.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"))
    there = docs.select(F.col(id_col).alias("_id")).distinct().join(known, "_id")
    # Bounded by ``sample`` rows, so that it can be sent to every task and the texts stay where they are.
    chosen = written(there.orderBy(F.xxhash64("_id"), "_id").limit(sample), "quality-sample")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_hash")).join(F.broadcast(chosen), "_id")

    def sparse(batches):
        for batch in batches:
            found = [terms(t) for t in batch["_text"]]
            places = [np.flatnonzero(v) for v in found]
            yield pd.DataFrame(
                {
                    "_id": batch["_id"],
                    "_hash": batch["_hash"],
                    "_label": batch["_label"],
                    "_at": [p.astype("<u2").tobytes() for p in places],
                    "_value": [v[p].astype("<f2").tobytes() for v, p in zip(found, places, strict=True)],
                }
            )

    ship(docs.sparkSession)
    schema = f"_id {dict(rows.dtypes)['_id']}, _hash long, _label int, _at binary, _value binary"
    told = rows.withColumn("_label", F.col("_label").cast("int")).mapInPandas(sparse, schema)
    # Of rows that share an id one is learned from, the same whatever the partitions.
    one = told.groupBy("_id").agg(F.min(F.struct("_hash", "_label", "_at", "_value")).alias("_one"))
    found = one.select("_id", "_one.*").toPandas()
    found = found.sort_values("_id", kind="stable")
    matrix = np.zeros((len(found), TERMS), np.float32)
    for row, at, value in zip(matrix, found["_at"], found["_value"], strict=True):
        row[np.frombuffer(at, "<u2")] = np.frombuffer(value, "<f2")
    return Vote(matrix, found["_label"].to_numpy())


def score(docs: DataFrame, vote: Vote, text_col="text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on), from the whole text alone.

    Every document is compared with all labelled vectors, a block of documents at a time.  Null and empty texts
    score the share of label 1.  Nothing is shuffled; columns named ``score`` or ``predicted`` are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vote)  # bounded by the sample and the space

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            blocks = (texts.iloc[i : i + BLOCK] for i in range(0, len(texts), BLOCK))
            scores = [sent.value.scores(np.stack([terms(t) for t in block])) for block in blocks]
            yield pd.Series(np.concatenate(scores) if scores else np.zeros(0))

    ship(docs.sparkSession)
    # Called once for each text, whatever filter stands on the score.
    judged = F.pandas_udf(judge, "double").asNondeterministic()
    scored = docs.withColumn("score", judged(F.col(text_col).cast("string")))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify_quality(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", folds=3, held=1, sample=SAMPLE) -> DataFrame:
    """``docs`` with ``held_out, score, predicted``, learned from labels whose fold is not ``held`` (see `fold`).

    Every row comes out once with its own columns, but those of the three names are replaced.  Null and empty texts
    score the share of label 1, a null id has the fold of an empty text, and rows that repeat an id are each scored
    by their own text.  Without labels every score is 0.5; an empty table gives an empty one.
    """
    learn = docs.filter(fold(id_col, folds) != held)
    scored = score(docs, fit(learn, labels, id_col=id_col, text_col=text_col, sample=sample), text_col)
    return scored.withColumn("held_out", fold(id_col, folds) == held)


def keep_good(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", sample=SAMPLE) -> DataFrame:
    """The rows of ``docs`` predicted to be of quality 1, with their columns; learned as by `classify_quality`."""
    labels = labels.select(F.col("quality").alias("_quality"), F.col(id_col).alias("_id"))

    def good(own, own_id, own_text):
        own_labels = labels.select(F.col("_quality").alias("quality"), F.col("_id").alias(own_id))
        found = classify_quality(own, own_labels, own_id, own_text, sample=sample)
        return found.filter("predicted = 1").select(own.columns)

    return under_own_names(docs, good, id_col, text_col)
