import numpy as np

from turnwise.llm.vectors import near_vectors, smallest


def brute(rows):
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    label = np.array(ids)
    while True:
        new = np.where(near, label, label.max()).min(1)
        if (new == label).all():
            break
        label = new
    return {i: (int(near[k].sum()) - 1, int(label[k])) for k, i in enumerate(ids)}


def test_embeddings(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(vectors).collect()}
    assert got == brute([(r.vec_id, r.embedding) for r in vectors.collect()])


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 0.0]), (3, [2.0, 0.0]), (2, [1.0, 0.0]), (7, None), (8, [0.0, 0.0]), (9, [nan, 1.0]), (10, [inf, 1.0]), (11, [1.0, None]), (12, []), (13, [1.0, 0.0, 0.0]), (14, [1e30, 1e28]), (None, [1.0, 0.0]), (7, None)]
    vectors = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, t int")
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(vectors).collect())
    alone = [(i, 0, i, True) for i in (7, 7, 8, 9, 10, 11, 12, 13)]
    assert got == sorted([(-1, 0, None, True), (2, 3, 2, True), (3, 3, 2, False), (5, 3, 2, False), (14, 3, 2, False), *alone])
    assert near_vectors(vectors.limit(0)).count() == 0


def test_buckets_of_many_chunks(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(0, 1, (3, 8))
    rows = [(i, (centre[i % 3] + rng.normal(0, 0.12, 8)).tolist()) for i in range(120)] + [(200 + i, rng.normal(0, 1, 8).tolist()) for i in range(40)]
    rows += [(400 + i, rows[0][1]) for i in range(9)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(vectors, chunk=4).collect()}
    assert got == brute(rows)


def test_smallest_reachable():
    assert smallest(7, np.array([5, 4, 3, 1]), np.array([4, 3, 6, 2])).tolist() == [0, 1, 1, 3, 3, 3, 3]
