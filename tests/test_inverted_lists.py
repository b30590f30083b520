import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import inverted_lists as I
from corvane.operators import vectors as V


@pytest.fixture(scope="module")
def clustered(spark):
    """2,000 vectors around 40 directions, a third of them around one; some without a direction."""
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(40, 32))
    of = np.where(rng.random(2000) < 0.33, 0, rng.integers(0, 40, 2000))
    x = middle[of] + 0.25 * rng.normal(size=(2000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 32), (5002, [1.0] * 7)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4).cache()
    queries = vectors.filter("vec_id % 40 = 0 AND vec_id < 5000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vectors, queries, x


def pairs(df):
    return {(r.query_id, r.vec_id) for r in df.collect()}


def test_few_lists_do_where_vectors_cluster(spark, clustered):
    vectors, queries, _ = clustered
    index = I.build_index(vectors, lists=40, parts=16)
    exact = V.knn_exact(queries, vectors.filter("size(embedding) = 32"), 10)
    (row,) = I.measured(queries, vectors, index, 10, 8, 190, exact).collect()
    assert row.recall >= 0.9 and row.share_compared <= 0.1 and row.share_scanned <= 0.5


def test_all_lists_and_all_candidates_are_exact(spark, clustered):
    vectors, queries, _ = clustered
    index = I.build_index(vectors, lists=10, parts=4, sample=300)
    got = I.knn_ivf(queries, vectors, index, 5, 10, 2000).collect()
    want = V.knn_exact(queries, vectors.filter("size(embedding) = 32"), 5).collect()
    assert {(r.query_id, r.rank, r.vec_id, round(r.cosine, 9)) for r in got} == {(r.query_id, r.rank, r.vec_id, round(r.cosine, 9)) for r in want}


def test_every_vector_is_coded_once_and_hot_lists_are_cut(spark, clustered):
    vectors, queries, _ = clustered
    index = I.build_index(vectors, lists=8, parts=8, block_bytes=16 * 50)
    blocks = index.blocks.collect()
    assert sorted(i for b in blocks for i in b.ids) == list(range(2000))
    assert all(len(b.codes) == 8 * len(b.ids) for b in blocks) and max(len(b.ids) for b in blocks) < 120
    whole = I.build_index(vectors, lists=8, parts=8)
    assert whole.blocks.count() == 8
    assert pairs(I.knn_ivf(queries, vectors, index, 5, 3, 40)) == pairs(I.knn_ivf(queries, vectors, whole, 5, 3, 40))


def test_groups_of_queries(spark, clustered, monkeypatch):
    vectors, queries, _ = clustered
    index = I.build_index(vectors, lists=8, parts=8)
    want = pairs(I.knn_ivf(queries, vectors, index, 5, 3, 40))
    monkeypatch.setattr(I, "QUERIES", 7)
    assert pairs(I.knn_ivf(queries, vectors, index, 5, 3, 40)) == want


def test_estimates_by_brute_force(spark, clustered):
    """Estimated cosines are those of the vectors rebuilt from their codes."""
    vectors, queries, x = clustered
    index = I.build_index(vectors, lists=8, parts=8)
    rebuilt = {}
    for b in index.blocks.collect():
        codes = np.frombuffer(b.codes, np.uint8).reshape(len(b.ids), -1)
        for i, c in zip(b.ids, codes, strict=True):
            rebuilt[i] = index.centres[b.list] + np.concatenate([index.words[j, k] for j, k in enumerate(c)])
    q = {r.query_id: np.array(r.query_vector) for r in queries.collect()}
    for r in I.candidates(queries, index, 8, 20).collect():
        assert r.about == pytest.approx(rebuilt[r.id] @ q[r.query_id] / np.linalg.norm(q[r.query_id]))


def test_opened_anew(spark, clustered):
    vectors, queries, _ = clustered
    index = I.build_index(vectors, lists=8, parts=8)
    again = I.open_index(spark, index.path)
    assert np.array_equal(again.centres, index.centres) and np.array_equal(again.words, index.words)
    assert pairs(I.knn_ivf(queries, vectors, again, 5, 3, 40)) == pairs(I.knn_ivf(queries, vectors, index, 5, 3, 40))


def test_edge_cases(spark, clustered):
    vectors, queries, _ = clustered
    empty = vectors.limit(0)
    assert I.knn_ivf(queries.filter("query_id < 0"), empty, I.build_index(empty, lists=4, parts=8), 3, 2, 5).count() == 0
    few = vectors.filter("vec_id < 3")
    found = I.knn_ivf(queries, few, I.build_index(few, lists=64, parts=8), 3, 64, 5)
    assert found.count() == 3 * queries.count()
    index = I.build_index(few, lists=2, parts=8)
    odd = spark.createDataFrame([(1, None), (2, [0.0] * 32), (3, [1.0])], "query_id long, query_vector array<double>")
    assert I.knn_ivf(odd, few, index, 3, 2, 5).count() == 0
    with pytest.raises(ValueError):
        I.build_index(few, parts=5)
    with pytest.raises(ValueError):
        I.knn_ivf(queries, few, index, 3, 2, 2)


def test_registered_recall(spark, sf):
    from corvane.plans import registry

    (row,) = registry.QUERIES["knn_ivf_recall"](spark, sf).collect()
    assert row.recall >= 0.9 and row.share_compared <= 0.1
