import random

import pytest

from spendloom.llm import topk


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, block int, queries int").repartition(3)


def brute(rows, k):
    import math

    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    for q, v in ok:
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)
            found += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(found)


@pytest.mark.parametrize("block", [4, 64])
def test_like_brute_force(spark, block):
    random.seed(8)
    rows = [(i, [random.randrange(-8, 9) / 8 for _ in range(6)]) for i in range(0, 900, 3)]
    rows += [(1, None), (2, []), (5, [None, 1.0]), (7, [float("nan")] * 6), (8, [float("inf")] * 6), (None, [1.0] * 6), (10, [0.5])]
    rows += [(100000 + i, [1.0] * 6) for i in range(30)]  # ties
    vectors = topk.weights(table(spark, rows))
    found = topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"), 10, block).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == brute(rows, 10)


def test_blocks_below_the_bound_are_not_scored(spark):
    rows = [(i, [float(i // 50), 0.5]) for i in range(400)]
    vectors = topk.weights(table(spark, rows))
    queries = vectors.filter("vec_id = 300")
    found = topk.top_k(vectors, queries, 3, 16).collect()
    assert sorted(r.vec_id for r in found) == [350, 351, 352]


def test_few_and_empty(spark):
    vectors = topk.weights(table(spark, [(0, [1.0]), (1, [2.0])]))
    assert [r.vec_id for r in topk.top_k(vectors, vectors.filter("vec_id = 0")).collect()] == [1]
    none = vectors.limit(0)
    assert topk.top_k(none, none).count() == 0


def test_whole_numbers_beyond_floats():
    import numpy as np

    a, b = np.array([[2**40 + 1, 3]]), np.array([[2**20 + 1, -5]])
    assert topk._product(a, b).tolist() == [[(2**40 + 1) * (2**20 + 1) - 15]]
