"""URL filters: rules of host and path, and for the rest a ratio of two character models learned from what the rules decide."""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.session import ship

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols of the models: a boundary, letters without case, any digit, each of these marks, and any other byte.
MARKS = "/.-_?=&%#:"
SYMBOLS = 1 + len(LOWER) + 1 + len(MARKS) + 1
#: The most symbols that a model looks back, and the cells of the table that follows: a fixed number.
ORDER = 3
CELLS = SYMBOLS ** (ORDER + 1)
#: Folds of hosts; a host's own fold is left out of the models that its pages are calibrated with.
FOLDS = 3
#: Steps of the scores' histogram, and the largest score that it tells from larger ones.
STEP, FAR = 1 / 128, 8


class Rule(NamedTuple):
    """Pages of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _symbol_table() -> np.ndarray:
    table = np.full(256, SYMBOLS - 1, np.int64)
    for i, (low, up) in enumerate(zip(LOWER, UPPER, strict=True)):
        table[[ord(low), ord(up)]] = 1 + i
    table[ord("0") : ord("9") + 1] = 1 + len(LOWER)
    for i, mark in enumerate(MARKS):
        table[ord(mark)] = 2 + len(LOWER) + i
    return table


SYMBOL = _symbol_table()


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to a slash, question mark or hash, A-Z lowered, and the path up to a question mark or hash."""
    rest = F.when(F.locate("://", url) > 0, F.substring_index(F.substring(url, F.locate("://", url) + 3, F.length(url)), "#", 1))
    rest = F.coalesce(F.substring_index(rest, "?", 1), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, UPPER, LOWER), F.substring(rest, F.length(host) + 1, F.length(rest))


def first_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest of the rules that fits, as a struct of ``rule`` and ``verdict``; null if none does."""
    chain = F
    for rule in sorted(rules, key=lambda r: (-len(r.name), r)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chain = chain.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict")))
    nothing = F.lit(None).cast("struct<rule: string, verdict: string>")
    return chain.otherwise(nothing) if rules else nothing


def cells_of(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The cell (symbol after its context) of each symbol of each URL and of its end, and how many each URL has."""
    data = [(url or "").encode() for url in urls]
    sizes = np.array([len(d) for d in data], np.int64)
    ends = np.cumsum(sizes + ORDER + 1)
    symbols = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    own = np.repeat(np.arange(len(data)), sizes)
    begin = ends - sizes - 1
    within = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    symbols[begin[own] + within] = SYMBOL[np.frombuffer(b"".join(data), np.uint8)]
    cell = np.zeros(len(symbols), np.int64)
    for back in range(ORDER + 1):
        cell[back:] += symbols[: len(symbols) - back] * SYMBOLS**back
    predicted = np.ones(len(symbols), bool)
    for back in range(ORDER):
        predicted[begin - 1 - back] = False
    return cell[predicted], sizes + 1


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """The log probability of every cell by a model of variable order.

    A context gives each symbol its share and, as often as it has seen different symbols, hands over to the context that is
    one symbol shorter (Witten and Bell).  A context never seen hands over altogether, so the order follows the evidence.  The
    shortest hands over to equal shares.
    """
    known = np.full(SYMBOLS, 1 / SYMBOLS)
    cells = counts.reshape((SYMBOLS,) * (ORDER + 1)).astype(np.float64)
    for order in range(ORDER + 1):
        own = cells.sum(tuple(range(ORDER - order)))
        total, kinds = own.sum(-1, keepdims=True), (own > 0).sum(-1, keepdims=True)
        known = np.where(total > 0, (own + kinds * known) / np.maximum(total + kinds, 1), known)
    return np.log(known).reshape(-1)


def differences(urls: list[str | None], tables: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """The log-likelihood difference a symbol of each URL, by the table of its fold."""
    cells, sizes = cells_of(urls)
    if not len(sizes):
        return np.zeros(0)
    own = tables[np.repeat(fold, sizes), cells].astype(np.float64)
    return np.add.reduceat(own, np.cumsum(sizes) - sizes) / sizes


def calibrate(scores: np.ndarray, allowed: np.ndarray, blocked: np.ndarray, rounds=50) -> tuple[float, float]:
    """Slope and offset of the logistic curve that best tells counts of allowed from blocked scores, both kinds weighing the same.

    Newton's method, each step halved until it helps, with a little weight on a slope of one; a slope that is not positive counts as one without offset.
    """
    weight = np.concatenate([allowed / allowed.sum(), blocked / blocked.sum()])
    x, y = np.tile(scores, 2), np.repeat([1.0, 0.0], len(scores))
    beta = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], 1)
    ridge = np.diag([1e-3, 1e-6])

    def loss(beta):
        z = design @ beta
        return weight @ (np.logaddexp(0, z) - y * z) + (beta - [1.0, 0.0]) @ ridge @ (beta - [1.0, 0.0]) / 2

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (p - y)) + ridge @ (beta - [1.0, 0.0])
        bend = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge
        step, size = np.linalg.solve(bend, slope), 1.0
        while size > 1e-9 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (1.0, 0.0)


def judge_urls(pages: DataFrame, rules: list[Rule], id_col="page_id", url_col="url") -> DataFrame:
    """Rows ``id, host, path, rule, verdict, score`` of every page.

    The longest rule that fits decides, of equally long ones the first by verdict and host.  What rules decide is also what two
    character models, of allowed and of blocked URLs, are counted on: all such URLs, with their repetitions.  Where no rule
    fits, ``score`` decides: the difference of the log-likelihoods of the whole URL under the two, a symbol, made a
    probability by a logistic curve.  The curve is fitted to the URLs that rules decide, each judged by models without
    its host's fold.  From 0.5 on the verdict is ``allow``.

    Null and empty URLs, and URLs without ``://``, have an empty host and path; no rule with a host fits them, and as texts
    of their own they get a score like any other.  If rules decide no URL as allowed, or none as blocked, there is nothing to compare:
    the score is 0 or 1, the only verdict seen, or 1 if none is.  Null and repeated ids and repeated rows are judged
    one by one, an empty table gives an empty one, other columns are left out.

    The rules are a list that the caller writes, not a table.  Counts are combined in tasks before they are shuffled, and there are ``CELLS``
    at most for each fold and verdict whatever the input; tables of ``CELLS`` numbers are all that is broadcast.
    """
    spark = ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"))
    host, path = host_and_path(F.col("_url"))
    rows = rows.withColumns({"host": host, "path": path})
    rows = rows.withColumn("_first", first_rule(F.col("host"), F.col("path"), rules))
    fold = F.pmod(F.crc32(F.col("host").cast("binary")), F.lit(FOLDS)).cast("int")
    decided = rows.filter("_first IS NOT NULL").select(
        "_url", (F.col("_first.verdict") == ALLOW).cast("int").alias("_allowed"), fold.alias("_fold")
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells, sizes = cells_of(list(batch["_url"]))
            group = (batch["_allowed"] * FOLDS + batch["_fold"]).to_numpy(np.int64)
            keys, n = np.unique(np.repeat(group, sizes) * CELLS + cells, return_counts=True)
            yield pd.DataFrame({"key": keys, "n": n})

    summed = decided.mapInPandas(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((2, FOLDS, CELLS))
    counts.reshape(-1)[summed["key"].to_numpy(np.int64)] = summed["n"]
    seen = counts.sum((1, 2)) > 0

    def told(score: Column) -> DataFrame:
        verdict = F.coalesce(F.col("_first.verdict"), F.when(F.col("_score") >= 0.5, ALLOW).otherwise(BLOCK))
        columns = [F.col("_id").alias(id_col), "host", "path", "_first.rule", verdict.alias("verdict"), F.col("_score").alias("score")]
        return rows.withColumn("_score", score).select(*columns)

    if not seen.all():
        return told(F.lit(0.0 if seen[0] else 1.0))

    def ratio(kinds: np.ndarray) -> np.ndarray:
        return (log_probabilities(kinds[1]) - log_probabilities(kinds[0])).astype(np.float32)

    total = counts.sum(1)
    without = spark.sparkContext.broadcast(np.stack([ratio(total - counts[:, k]) for k in range(FOLDS)]))
    whole = spark.sparkContext.broadcast(ratio(total)[None])
    last = int(FAR / STEP)

    @F.pandas_udf("int")
    def place(urls: pd.Series, folds: pd.Series) -> pd.Series:
        found = differences(list(urls), without.value, folds.to_numpy())
        return pd.Series(np.clip(np.rint(found / STEP), -last, last).astype(np.int32))

    found = decided.select(place("_url", "_fold").alias("place"), "_allowed").groupBy("place", "_allowed").agg(F.count("*").alias("n"))
    histogram = np.zeros((2, 2 * last + 1))
    for r in found.collect():
        histogram[r["_allowed"], r["place"] + last] = r["n"]
    slope, offset = calibrate(np.arange(-last, last + 1) * STEP, histogram[1], histogram[0])

    @F.pandas_udf("double")
    def probability(urls: pd.Series) -> pd.Series:
        found = differences(list(urls), whole.value, np.zeros(len(urls), np.int64))
        return pd.Series(1 / (1 + np.exp(-np.clip(slope * found + offset, -700, 700))))

    return told(probability("_url"))
