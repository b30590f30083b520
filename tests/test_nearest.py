"""Nearest vectors ranked in the tasks: ties, shared keys, and no row a pair."""

import numpy as np
import pytest

from corvane.operators import vectors as V
from corvane.plans import q_eval


@pytest.fixture
def small_steps(monkeypatch):
    monkeypatch.setattr(V, "SCORES", 16)


def _brute(q, v, k, fine=lambda a, b: True):
    unit = lambda x: np.asarray(x, float) / np.linalg.norm(x)
    return {i: [b for _, b in sorted((-round(float(unit(x) @ unit(y)), 9), b) for b, y in v if np.any(y) and fine(i, b))[:k]] for i, x in q}


def test_nearest_equal_brute_force(spark, small_steps):
    rng = np.random.default_rng(3)
    v = [(int(i), rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(60)] + [(i, [1.0, 2.0, 0.0, 1.0]) for i in range(60, 90)]
    v = [(i, x) for i, x in v if any(x)] + [(95, [0.0] * 4)]
    vectors = spark.createDataFrame([*v, (96, None)], "vec_id long, embedding array<double>").repartition(4)
    q = [(i, x) for i, x in v if i % 10 == 0]
    queries = spark.createDataFrame(q, "query_id long, query_vector array<double>")
    lists = lambda df: {i: [r.vec_id for r in sorted(df.collect(), key=lambda r: r.rank) if r.query_id == i] for i, _ in q}
    assert lists(V.knn_exact(queries, vectors, 5)) == _brute(q, v, 5)
    assert lists(V.knn_exact(queries, vectors, 5, others=True)) == _brute(q, v, 5, lambda a, b: a != b)
    planes = np.random.default_rng(0).normal(size=(4, 6))
    key = {i: (np.asarray(x) @ planes > 0).reshape(3, 2) @ (1, 2) for i, x in v}
    assert lists(V.knn_lsh(queries, vectors, 5, tables=3, bits=2)) == _brute(q, v, 5, lambda a, b: (key[a] == key[b]).any())


def test_candidates_of_keys_are_not_shuffled(spark, sf):
    from corvane.plans.views import query_vectors, vectors

    found = V.knn_lsh(query_vectors(spark, sf), vectors(spark, sf), 10, tables=16, bits=4)
    assert "Join" not in found._jdf.queryExecution().toString()


def test_reports_rank_in_the_tasks(spark, sf, monkeypatch):
    monkeypatch.setattr(V, "all_scores", lambda *a, **b: pytest.fail("a row for each pair"))
    assert q_eval.eval_report(spark, sf).count() == 2
