"""Exact similarity join of shingle sets by a token-group matrix.

Similar sets are put into groups.  The matrix tells which token is in which group's union.  A set can only be
similar to a member of a group that holds enough of its tokens, so only such groups are opened.
"""

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import removed, scratch, told_apart, under_own_names, written
from demandlens.llm.components import components, least_reached
from demandlens.llm.shingles import set_key, shingle_set
from demandlens.session import ship

#: Counters of the sketch that tells common tokens from rare ones; its size is fixed.
COUNTERS, SLICES = 1 << 20, 64
#: Members of a group at most; larger groups are split, and their parts are compared with each other.
MEMBERS = 256
#: Cells of a block of the incidence matrix of an opened group.
CELLS = 1 << 22
SETS = "_id string, n long, key binary, pair long, slice int, counts binary"


def least_overlap(n, num: int, den: int):
    """Tokens that a set of ``n`` shares at least with any set as similar as ``num / den``."""
    return -(-n * num // den)


def grouping_key(found: np.ndarray) -> int:
    """Near copies mostly agree on it: two independent minima of the set, mixed."""
    second = (found * np.uint64(0x9FB21C651E98DF25)) ^ (found >> np.uint64(29))
    return int(np.int64((int(found[0]) * 31 + int(second.min())) % (1 << 63)))


def rare_first(found: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The tokens in one order for all sets: by how many sets hold them, as the sketch tells, and by value."""
    return found[np.lexsort((found, sketch[(found % np.uint64(COUNTERS)).astype(np.int64)]))]


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """Size and keys of every document's set and, with ``slice``, what a task adds to the sketch: in how many documents
    with an id each counter's tokens are.  One pass over the texts makes both."""

    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            found = [shingle_set(t, words) for t in batch["_text"]]
            for own, there in zip(found, batch["_id"].notna(), strict=True):
                if there:
                    np.add.at(total, (own % np.uint64(COUNTERS)).astype(np.int64), 1)
            yield pd.DataFrame(
                {
                    "_id": batch["_id"],
                    "n": [len(s) for s in found],
                    "key": [set_key(s) for s in found],
                    "pair": [grouping_key(s) if len(s) else 0 for s in found],
                    "slice": None,
                    "counts": None,
                }
            )
        parts = np.minimum(total, np.iinfo(np.uint16).max).astype("<u2").reshape(SLICES, -1)
        rows = [(None, 0, None, 0, k, p.tobytes()) for k, p in enumerate(parts)]
        yield pd.DataFrame(rows, columns=["_id", "n", "key", "pair", "slice", "counts"])

    return docs.mapInPandas(run, SETS)


def _sketch(counted: DataFrame) -> np.ndarray:
    """In about how many documents each counter's tokens are, over all documents: a table of fixed size."""

    def add(key, group):
        total = sum(np.frombuffer(c, "<u2").astype(np.int64) for c in group["counts"])
        return pd.DataFrame({"slice": [key[0]], "counts": [np.minimum(total, np.iinfo(np.uint32).max).astype("<u4").tobytes()]})

    merged = counted.select("slice", "counts").groupBy("slice").applyInPandas(add, "slice int, counts binary").collect()
    out = np.zeros((SLICES, COUNTERS // SLICES), np.uint32)
    for row in merged:
        out[row["slice"]] = np.frombuffer(row["counts"], "<u4")
    return out.reshape(-1)


def open_groups(left, right, num: int, den: int):
    """Links between the members of two groups, or within one if ``right`` is None.

    A side is ``(ids, sets)``.  First the overlap of every query with the other group's union is bounded; only
    queries that hold enough of it are compared with the members, by exact counts of shared tokens.  Yields pairs of ids.
    """
    ids, sets = left if right is None else (left[0] + right[0], left[1] + right[1])
    cut = len(left[0])
    sizes = np.array([len(s) for s in sets])
    keep = np.ones(len(sets), bool)
    if right is not None:
        for mine, other in ((slice(0, cut), slice(cut, None)), (slice(cut, None), slice(0, cut))):
            union = np.unique(np.concatenate(sets[other]))
            for k in range(*mine.indices(len(sets))):
                at = np.searchsorted(union, sets[k])
                held = int((union[np.minimum(at, len(union) - 1)] == sets[k]).sum())
                keep[k] = held >= least_overlap(len(sets[k]), num, den)
        if not keep[:cut].any() or not keep[cut:].any():
            return []
    chosen = np.flatnonzero(keep)
    tokens, place = np.unique(np.concatenate([sets[k] for k in chosen]), return_inverse=True)
    row = np.repeat(np.arange(len(chosen)), sizes[chosen])
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    shared = np.zeros((len(chosen), len(chosen)), np.float32)
    width = max(1, CELLS // len(chosen))
    for at in range(0, len(tokens), width):
        lo, hi = np.searchsorted(place, (at, at + width))
        block = np.zeros((len(chosen), min(width, len(tokens) - at)), np.float32)
        block[row[lo:hi], place[lo:hi] - at] = 1
        shared += block @ block.T
    inner = np.rint(shared).astype(np.int64)
    n = sizes[chosen]
    near = den * inner >= num * (n[:, None] + n[None, :] - inner)
    a, b = np.nonzero(np.triu(near, 1))
    if right is not None:
        across = (chosen[a] < cut) != (chosen[b] < cut)
        a, b = a[across], b[across]
    return [(ids[chosen[x]], ids[chosen[y]]) for x, y in zip(a, b, strict=True)]


def near_sets(docs: DataFrame, words=4, num=85, den=100, id_col="doc_id", text_col="text") -> DataFrame:
    """Rows ``id, n_shingles, component_id, n_links`` of every document.

    A document's set has its distinct shingles of ``words`` words (see `shingle_set`); two documents link if
    ``den * shared >= num * united``; ``component_id`` is the smallest id reachable by links, and ``n_links`` counts the
    other rows with an id that a row links with.  A null or empty text has no shingles and links with nothing, nor
    does a row without an id (its component is null).  Rows that repeat an id are one node, but each has its own
    links.  An empty table gives an empty one.  Other columns are left out.  No link is missed.

    1. Equal sets become one class, under its smallest id.
    2. Classes are grouped by two minima of their set, which near copies mostly share; groups of more than
       ``MEMBERS`` are split.
    3. The matrix: tokens are put in one order, rare ones first; as many of a set as a similar set cannot all
       lack make its row.  Groups that share a token in the union of their rows are candidates.
    4. Candidates meet with their members' texts, each pair of groups once.  The overlap of each query with the
       other group's union is bounded, and the members are compared where it suffices.  A task gives a row for each
       class with links, not one for each link.
    5. What the links reach in each task connects the components; links are added up by class.

    Every pair that links shares one of those tokens, whatever the sketch says of their frequency.
    """
    spark = ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    ided = texts.filter(F.col("_id").isNotNull())
    named = texts.withColumn("_id", F.col("_id").cast("string"))  # as text, for a null among numbers would make them floats
    made = written(_sets(named, words).withColumn("_id", F.col("_id").cast("long")), "ngram-sets")
    members = made.filter("slice IS NULL").drop("slice", "counts")
    classes = (
        members.filter("n > 0 and _id is not null")
        .groupBy("key")
        .agg(F.min("_id").alias("_rep"), F.first("n").alias("n"), F.first("pair").alias("pair"), F.count(F.lit(1)).alias("_copies"))
    )
    classes = written(classes, "ngram-classes")
    parts = classes.groupBy("pair").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("_parts"))
    part = F.pmod(F.xxhash64("_rep", "key"), F.col("_parts"))
    grouped = classes.join(parts, "pair").withColumn("_part", part)
    first = grouped.groupBy("pair", "_part").agg(F.min("_rep").alias("_group"), F.count(F.lit(1)).alias("_members"))
    kept = {name: scratch(spark, f"ngram-{name}") for name in ("groups", "candidates", "asked", "texts")}
    grouped = grouped.join(first, ["pair", "_part"]).select("_rep", "key", "n", "_copies", "_group", "_members")
    grouped = written(grouped, "ngram-groups", path=kept["groups"])

    sketch = spark.sparkContext.broadcast(_sketch(made.filter("slice IS NOT NULL")))  # of a fixed size

    def rows(batches):
        for batch in batches:
            found = [shingle_set(t, words) for t in batch["_text"]]
            yield pd.DataFrame(
                {
                    "_id": batch["_id"],
                    "key": [set_key(s) for s in found],
                    "_row": [rare_first(s, sketch.value)[: len(s) - least_overlap(len(s), num, den) + 1].tobytes() for s in found],
                }
            )

    def tokens(batches):
        for batch in batches:
            found = [np.frombuffer(r, np.int64) for r in batch["_row"]]
            sizes = [len(f) for f in found]
            if sum(sizes):
                n = np.repeat(batch["n"].to_numpy(), sizes)
                yield pd.DataFrame(
                    {
                        "_token": np.concatenate(found),
                        "_group": np.repeat(batch["_group"].to_numpy(), sizes),
                        "n": n,
                        "_rest": n - np.concatenate([np.arange(k) for k in sizes]),
                    }
                )

    packed = ided.mapInPandas(rows, "_id long, key binary, _row binary").filter("length(_row) > 0")
    own = packed.join(grouped.withColumnRenamed("_rep", "_id"), ["_id", "key"]).select("_row", "_group", "n")
    matrix = (
        own.mapInPandas(tokens, "_token long, _group long, n long, _rest long")
        .repartition("_token")
        .groupBy("_token", "_group")
        .agg(F.min("n").alias("_least"), F.max("n").alias("_most"), F.max("_rest").alias("_rest"))
    )
    other = matrix.select("_token", *[F.col(c).alias(f"{c}2") for c in ("_group", "_least", "_most", "_rest")])
    # Sizes must allow the similarity, and so must what is left of both sets from their first shared token on.
    fits = (F.col("_least2") * num <= F.col("_most") * den) & (F.col("_least") * num <= F.col("_most2") * den)
    fits = fits & (F.least("_rest", "_rest2") * (num + den) >= (F.col("_least") + F.col("_least2")) * num)
    pairs = (
        matrix.join(other, "_token").filter((F.col("_group") < F.col("_group2")) & fits).select("_group", "_group2").distinct()
    )
    within = grouped.filter("_members > 1").select("_group", F.col("_group").alias("_group2")).distinct()
    pairs = written(pairs.union(within), "ngram-candidates", path=kept["candidates"])

    asked = pairs.select(F.col("_group")).union(pairs.select("_group2")).distinct().join(grouped, "_group")
    asked = asked.select(F.col("_rep").alias("_id"), "key", "_copies", F.col("_group").alias("_at"), "_members")
    asked = written(asked, "ngram-asked", path=kept["asked"])
    # Texts are moved for these joins at every size, so that small and large inputs have one plan.
    held = told_apart(ided, "_id", asked, "_id")[0].join(asked.drop("_members").hint("merge"), "_id")
    held = written(held, "ngram-texts", path=kept["texts"])
    weights = asked.select(F.col("_at").alias("_group2"), "_members").distinct()

    def verify(key, group):
        found = [shingle_set(t, words) for t in group["_text"]]
        members, seen = defaultdict(lambda: ([], [])), set()
        for place, (at, told, mine) in enumerate(zip(group["_at"], group["key"], found, strict=True)):
            # A repeated id has other texts, or the same text again.
            if set_key(mine) == told and (at, told) not in seen:
                seen.add((at, told))
                members[at][0].append(place)
                members[at][1].append(mine)
        first, links = members.pop(key[0], ([], [])), []
        if group["_within"].any() and first[0]:
            links += open_groups(first, None, num, den)
        for side in members.values():
            if first[0]:
                links += open_groups(first, side, num, den)
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        reps, copies, linked = group["_id"].to_numpy(), group["_copies"].to_numpy(), np.zeros(len(group), np.int64)
        np.add.at(linked, a, copies[b])
        np.add.at(linked, b, copies[a])
        touched = np.union1d(a, b)
        root = least_reached(reps, a, b)
        return pd.DataFrame(
            {"key": group["key"].to_numpy()[touched], "_rep": reps[touched], "_links": linked[touched], "_root": root[touched]}
        )

    # A group meets its partners together, so many at a time as are ``MEMBERS`` sets.
    blocks = pairs.join(weights, "_group2").groupBy("_group").agg(F.ceil(F.sum("_members") / MEMBERS).cast("int").alias("_n"))
    placed = pairs.join(blocks, "_group").withColumn("_block", F.pmod(F.xxhash64("_group2"), F.col("_n")))
    theirs = placed.select("_group", "_block", F.col("_group2").alias("_at"), (F.col("_group") == F.col("_group2")).alias("_within"))
    sides = theirs.union(placed.select("_group", "_block", F.col("_group").alias("_at"), F.lit(False).alias("_within")))
    sides = sides.groupBy("_group", "_block", "_at").agg(F.max("_within").alias("_within"))
    opened = held.join(sides.hint("merge"), "_at").groupBy("_group", "_block")
    links = written(opened.applyInPandas(verify, "key binary, _rep long, _links long, _root long"), "ngram-links")
    for path in kept.values():
        removed(spark, path)
    # An id whose texts are of several classes joins them.
    again = members.filter("n > 0 and _id is not null").join(classes.select("key", "_rep"), "key")
    repeated = again.filter("_id != _rep").groupBy("_id").agg(F.min("_rep").alias("a"), F.max("_rep").alias("b")).filter("a != b")
    known = links.select(F.col("_rep").alias("src"), F.col("_root").alias("dst"))
    reached = components(known.union(repeated.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    found = (
        classes.join(reached.withColumnRenamed("id", "_rep"), "_rep", "left")
        .join(links.groupBy("key").agg(F.sum("_links").alias("_links")), "key", "left")
        .select("key", F.coalesce("component", "_rep").alias("component_id"), (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("_linked"))
    )
    component = F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id"))
    linked = F.when(F.col("_id").isNotNull(), F.coalesce("_linked", F.lit(0))).otherwise(0).cast("long")
    return members.join(found, "key", "left").select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), linked.alias("n_links")
    )


def keep_smallest(docs: DataFrame, words=5, num=80, den=100, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with all their columns.

    Rows without an id stay: nothing is known that they repeat.
    """
    return under_own_names(docs, lambda d, i, t: _keep_smallest(d, words, num, den, i, t), id_col, text_col)


def _keep_smallest(docs, words, num, den, id_col, text_col):
    found = near_sets(docs, words, num, den, id_col, text_col).filter(F.col(id_col) != F.col("component_id"))
    gone = written(found.select(F.col(id_col).alias("_gone")).distinct(), "ngram-gone")
    maybe, others = told_apart(docs.withColumn("_long", F.col(id_col).cast("long")), "_long", gone, "_gone")
    stay = maybe.join(gone, maybe["_long"] == gone["_gone"], "left_anti")
    return others.union(stay).drop("_long")
