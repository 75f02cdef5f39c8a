import math

import numpy as np
import pytest

from turnwise.llm.negatives import Index, hard_negatives


def brute(rows):
    """The contract, all pairs, with whole numbers of any size."""
    good = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        good.append((i, [math.floor(256 * c) for c in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, x, label in good:
        if a % 50:
            continue
        score = lambda r: sum(p * q for p, q in zip(x, r[1], strict=True))  # noqa: E731, B023
        ranked = sorted((-score(r), r[0], r[2]) for r in good if r[0] != a and len(r[1]) == len(x))
        for s, p, _ in [r for r in ranked if r[2] == label][:5]:
            fits = [r for r in ranked if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
            out += [(a, p, k + 1, r[1], -s, -r[0]) for k, r in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("how", [{}, {"buckets": 4, "chunk": 16, "block": 3}])
def test_whole_table(spark, how):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = sorted(tuple(r) for r in hard_negatives(vectors, **how).collect())
    assert got == brute([(r.vec_id, r.embedding, r.label) for r in vectors.collect()]) and len(got) > 100


def test_ties_lengths_and_hot_vectors(spark):
    """Few different whole-number vectors, so scores tie; lengths from 0 to 40; one vector is a third of all rows."""
    rng = np.random.default_rng(11)
    rows = [(i, (rng.integers(-3, 4, 5) * rng.choice([0, 1, 10])).astype(float).tolist(), int(rng.integers(0, 10))) for i in range(400)]
    rows = [(i, [1.0, 2.0, 0.0, 0.0, 1.0], label) if i % 3 == 0 else (i, v, label) for i, v, label in rows]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute(rows)
    for how in ({}, {"buckets": 3, "chunk": 20, "block": 2, "focus": 5}):
        assert sorted(tuple(r) for r in hard_negatives(vectors, **how).collect()) == want and len(want) > 50


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (50, [1.0, 0.5], 2), (1, [1.0, 0.9], 2), (2, [0.9, 0.4], 3), (3, None, 2), (4, [nan, 1.0], 2), (5, [inf, 0.0], 2), (6, [None, 1.0], 2), (8, [1.0, 0.2], None), (None, [1.0, 1.0], 2)]
    rows += [(9, [1.0, 1.0, 1.0], 2), (100, [-1.0, 0.0], 3), (10, [-1.0, 0.1], 3), (11, [], 2), (150, [0.0, 0.0], 5), (12, [1.0, 0.0], 5), (13, [1e300, 1.0], 2), (-50, [0.8, 0.7], 3), (-7, [0.4, 0.2], 2)]
    vectors = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, label int, row string, d int")
    got = sorted(tuple(r) for r in hard_negatives(vectors).where("positive_score < 1000000").collect())
    assert got == sorted(r for r in brute(rows) if r[4] < 1_000_000)
    assert hard_negatives(vectors.union(vectors)).where("positive_score < 1000000").count() == len(got)  # equal rows are one
    assert hard_negatives(vectors.limit(0)).count() == 0


def test_pruning_leaves_all_that_reach_the_threshold():
    rng = np.random.default_rng(3)
    x = rng.integers(-200, 200, (500, 6))
    index = Index(np.arange(500), np.zeros(500, np.int64), np.arange(500), x)
    for _ in range(50):
        q = rng.integers(-200, 200, 6)
        s, length = x @ q, float(np.sqrt((q.astype(float) ** 2).sum()))
        order = np.argsort(index.ids)
        for least in (-50_000, -1, 0, 1, 30_000, 60_000, int(s.max())):
            at = index.candidates(q, length, least, 3)
            reached = set(np.flatnonzero(s >= least).tolist())
            assert reached <= (set(range(500)) if at is None else set(index.ids[at].tolist()))
        assert at is not None and len(at) < 250 and len(order) == 500
