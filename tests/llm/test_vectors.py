import math

import numpy as np

from demandlens.llm.components import components
from demandlens.llm.vectors import near_duplicates, tables_for


def expected(rows, threshold):
    ok = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    unit = [np.array(v, float) / max(map(abs, v)) if i is not None and ok(v) else None for i, v in rows]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    top = {i: i for i, _ in rows if i is not None}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    links = [0] * len(rows)
    for a, u in enumerate(unit):
        for b, v in enumerate(unit):
            if a != b and u is not None and v is not None and len(u) == len(v) and u @ v >= threshold:
                links[a] += 1
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                top[y] = x
    out = [(i, n, None if i is None else find(i), i is not None and find(i) == i) for (i, _), n in zip(rows, links)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    data = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0, None]), (7, [inf, 1.0]), (8, [nan, 0.0]),
        (9, [-1.0, 0.0]), (10, [1.0, 0.0]), (10, [1.0, 0.0]), (None, [1.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [1e300, 1e290]),
        (13, [1e-300, 0.0]), (14, [0.0, 1.0]),
    ]
    docs = spark.createDataFrame([(*r, 1, 2) for r in data], "vec_id long, embedding array<double>, _rep int, _n int")
    assert rows(near_duplicates(docs)) == expected(data, 0.9)
    assert rows(near_duplicates(docs.limit(0))) == []


def test_groups_larger_than_a_block(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((6, 16))
    vectors = np.concatenate([b + 0.08 * rng.standard_normal((40, 16)) for b in base] + [rng.standard_normal((60, 16))])
    data = [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(len(vectors)), vectors)]
    data += [(1000 + i, data[0][1]) for i in range(30)]
    docs = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(4)
    found = rows(near_duplicates(docs, recall=1 - 1e-9, block=16))
    assert found == expected(data, 0.9) and any(n > 60 for _, n, _, _ in found)


def test_tables_keep_the_recall():
    for n in (1, 500, 10**5, 10**9):
        bits, tables = tables_for(n)
        meet = (1 - math.acos(0.9) / math.pi) ** bits
        assert 1 - (1 - meet) ** tables >= 0.999


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, i) for i in range(101, 200)]
    pairs = [*chain, *star, (500, 500), (None, 3), (700, 699)]
    found = dict(map(tuple, components(spark.createDataFrame(pairs, "src long, dst long").repartition(4)).collect()))
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 200)} | {699: 699, 700: 699}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0
