import math

import numpy as np
import pytest

from strandloom.llm import topk


def brute(rows, k=10, every=100):
    good = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for q, x in sorted({(i, tuple(v)) for i, v in good if i % every == 0}):
        scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in good if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def run(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    return sorted(tuple(r) for r in topk.search(frame, **options).collect())


@pytest.mark.parametrize("options", [{}, {"centres": 5, "block_rows": 40, "group_rows": 3, "sample_rows": 50}])
def test_against_brute_force(spark, options):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(6, 8))
    rows = [(i, (middles[i % 6] + 0.1 * rng.normal(size=8)).tolist()) for i in range(900)]
    rows += [(2000 + i, rows[1][1]) for i in range(150)]  # one hot vector
    rows += [(None, [1.0] * 8), (50, None), (51, [1.0, None]), (52, [float("nan")] * 8), (53, [float("inf")] * 8), (54, []), (55, [5.0]), (57, [0.1] * 12), (58, rows[1][1]), (58, rows[1][1]), rows[100], rows[100]]
    assert run(spark, rows, **options) == brute(rows)


def test_few_candidates_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, -1.0]), (2, [0.5, -1.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(1, [1.0]), (2, [1.0])]) == []
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_bound_holds():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.normal(size=(40, 5)) * 10, rng.normal(size=(30, 5)) + 3
        assert (a @ b.T).max() <= topk.bound(topk.cover_tree(a), topk.cover_tree(b)) + 1e-6


def test_large_integers_stay_exact():
    a = np.array([[2**30, 3]], dtype=np.int64)
    assert topk.products(a, np.array([[2**30, 5]], dtype=np.int64))[0, 0] == 2**60 + 15


def test_clashing_columns_and_values_beyond_64_bits(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e300, 0.0]), (3, [1.0, 1.0])]
    frame = spark.createDataFrame([(i, v, 7, 7, 7, 7, 7, 7) for i, v in rows], "vec_id long, embedding array<double>, query_id int, rank int, node int, part int, x int, spot int")
    found = topk.search(frame, k=2)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in found.collect()) == [(0, 1, 1, 2**63 - 1), (0, 2, 3, 2**63 - 1)]
