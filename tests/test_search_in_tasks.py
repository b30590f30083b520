"""Searches that rank in their tasks: nothing lost to the cut, no row a pair shuffled."""

import numpy as np
import pytest

from corvane.operators import chunking as C
from corvane.operators import lexical as E


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.fixture
def small_steps(monkeypatch):
    monkeypatch.setattr(E, "CELLS", 16)
    monkeypatch.setattr(E, "GATHERED", 4)


def test_foremost_keeps_what_the_cap_makes_room_for():
    # the fourth hit of document 1 goes, so the hits of 2 and 3 stay
    q, d, c = np.zeros(6, int), np.array([1, 1, 1, 1, 2, 3]), np.arange(6)
    s = np.array([9.0, 8, 7, 6, 5, 4])
    assert sorted(E._foremost(q, d, c, s, 5, 3)) == [0, 1, 2, 4, 5]
    assert sorted(E._foremost(q, d, c, s, 2, 3)) == [0, 1, 2, 4]
    assert sorted(E._foremost(q, d, c, s, 2, None)) == [0, 1]


@pytest.mark.parametrize("k, cap", [(3, 1), (4, 2), (5, None)])
def test_search_equals_ranks_of_all_scores(spark, small_steps, k, cap):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(12)]
    rows = [(int(i // 3), int(i), " ".join(rng.choice(words, 6))) for i in range(90)] + [(100, 1000, "the"), (101, 1001, None)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_id long, text string").repartition(5, "chunk_id")
    docs = spark.createDataFrame([(i, "ready" if i % 7 else "indexing") for i in range(30)], "doc_id long, status string")
    queries = spark.createDataFrame([(i, " ".join(rng.choice(words, 2))) for i in range(6)] + [(9, "nowhere")], "query_id long, query string")
    allowed = spark.createDataFrame([(0, 4), (0, 5), (0, 7), (3, 8)], "query_id long, doc_id long")
    scores = E.lexical_rank(E.or_query_terms(queries), chunks)
    for some in (None, allowed):
        want = scores.join(docs.filter("status = 'ready'").select("doc_id"), "doc_id", "left_semi")
        want = want if some is None else E.narrow(want, some)
        want = want if cap is None else E.per_document_cap(want, cap)
        want = E.top_per_group(want, ["query_id"], [E.F.desc(E.F.round("score", 9)), "chunk_id"], k)
        found = E.search_chunks(queries, chunks, docs, k, cap, allowed=some)
        key = lambda df: sorted((r.query_id, r.rank, r.chunk_id, r.doc_id, round(r.score, 9)) for r in df.collect())
        assert key(found) == key(want)


def test_scores_equal_those_of_joined_terms(spark, small_steps, monkeypatch):
    chunks = spark.createDataFrame([(1, 10, "Wind und Sonne, Wind"), (1, 11, "the sun"), (2, 20, "Sonne KK x")], "doc_id long, chunk_id long, text string")
    terms = E.or_query_terms(spark.createDataFrame([(1, "wind sonne"), (2, "sun x kk")], "query_id long, query string"))
    found = lambda: {(r.query_id, r.chunk_id): round(r.score, 9) for r in E.lexical_rank(terms, chunks).collect()}
    pairs = lambda: {(r.query_id, r.chunk_id) for r in E.lexical_match(terms, chunks).collect()}
    scores, met = found(), pairs()
    assert met == set(scores) == {(1, 10), (1, 20), (2, 11), (2, 20)}
    monkeypatch.setattr(E, "SMALL_ROWS", 0)
    assert found() == scores and pairs() == met


def test_search_shuffles_no_row_a_pair(spark, sf):
    from corvane.plans.views import chunks, queries

    assert "Exchange" not in plan(E.lexical_rank(E.or_query_terms(queries(spark, sf)), chunks(spark, sf)))


def test_chunks_are_cut_before_they_become_rows(spark):
    docs = spark.createDataFrame([(1, "a" * 5 + " " * 5 + "b" * 3), (2, None), (3, "")], "doc_id long, text string")
    cut = C.chunk_fixed(docs, "doc_id", "text", 5, 0).select("doc_id", "ordinal", "chunk_text")
    assert [tuple(r) for r in cut.collect()] == [(1, 0, "aaaaa"), (1, 2, "bbb")]
    assert "Generate posexplode(transform(" in plan(cut) and "[text#" not in plan(cut).split("Optimized Logical Plan")[1].split("Generate")[0]
