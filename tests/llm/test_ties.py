"""Ties among neighbours go to the smaller ids, scores and ranks are those of a full search, recall."""

import numpy as np
import pyarrow as pa
from paramill.llm import neighbours


def test_ties_go_to_the_smaller_ids():
    rng = np.random.default_rng(0)
    for trial in range(20):
        base = rng.normal(size=16)
        vectors = np.concatenate([base * 2.0 ** rng.integers(-5, 6, (40, 1)), rng.normal(size=(60, 16))])
        groups = rng.permutation(100) + 1
        units = neighbours._units(vectors)
        q, c, score = neighbours.best_pairs(units, groups, np.arange(40), np.arange(100), 6)
        exact = (units[:, None] * units[None]).sum(axis=2)
        for i in range(40):
            want = sorted(range(100), key=lambda j: (-exact[i, j], groups[j]))[:6]
            assert c[q == i].tolist() == want and score[q == i].tolist() == [exact[i, j] for j in want]
        assert sorted(groups[c[q == 0]].tolist()) == sorted(groups[:40])[:6]


def test_scores_and_ranks(spark):
    rows = [(i, [1.0 + (i % 7), 2.0, float(i % 3), 0.5], 0) for i in range(120)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    vectors = np.array([r[1] for r in rows], dtype=np.float64)
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cosine = np.round(units @ units.T, 9)
    for i in (0, 50, 100):
        want = sorted((j for j in range(120) if j != i), key=lambda j: (-cosine[i, j], j))[:5]
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == i)
        assert [r[:2] for r in own] == [(n + 1, j) for n, j in enumerate(want)]
        np.testing.assert_allclose([r[2] for r in own], [cosine[i, j] for j in want], atol=1e-8)


def test_recall_where_a_tenth_of_the_table_is_met(spark):
    n, rows_of_a_range = 50_000, 64
    assert neighbours.ORDERINGS * 3 * rows_of_a_range < n / 10
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(1000, 32))
    vectors = centres[rng.integers(0, 1000, n)] + rng.normal(size=(n, 32)) * 0.35
    table = pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.array(list(vectors), pa.list_(pa.float64()))})
    got = neighbours.nearest(spark.createDataFrame(table), step=250, range_rows=rows_of_a_range).collect()
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    found = 0
    for query in range(0, n, 250):
        cosine = units @ units[query]
        cosine[query] = -2
        best = set(np.argsort(-cosine)[:5].tolist())
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == query)
        assert [r[0] for r in own] == [1, 2, 3, 4, 5] and query not in {r[1] for r in own}
        np.testing.assert_allclose([r[2] for r in own], [cosine[r[1]] for r in own], atol=1e-9)
        found += len(best & {r[1] for r in own})
    assert found >= 0.9 * n / 250 * 5


def test_recall_without_structure(spark):
    """No clusters at all: the default ranges meet less than the table and still find nine in ten."""
    n = 6000
    assert neighbours.ORDERINGS * 3 * neighbours.block_rows(n) < n
    vectors = np.random.default_rng(5).normal(size=(n, 64))
    table = pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.array(list(vectors), pa.list_(pa.float64()))})
    got = neighbours.nearest(spark.createDataFrame(table)).collect()
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    found = 0
    for query in range(0, n, 50):
        cosine = units @ units[query]
        cosine[query] = -2
        found += len(set(np.argsort(-cosine)[:5].tolist()) & {r.vec_id for r in got if r.query_id == query})
    assert found >= 0.9 * n / 50 * 5
