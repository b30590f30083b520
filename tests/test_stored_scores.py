"""Stored search: scores are summed in the tasks that hold a part of the documents, with the hits of the scan."""

import random
import re

from corvane.operators import postings as P


def _hits(df):
    return sorted((r.query_id, r.rank, r.chunk_id, r.doc_id, round(r.score, 6)) for r in df.collect())


def test_ties_caps_and_portions_as_in_the_scan(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randrange(1, 5))) for _ in range(12)]
    rows = [(i // 5 if i % 31 else None, i, texts[rng.randrange(12)]) for i in range(300)]  # many chunks are equal
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_id long, text string")
    docs = spark.createDataFrame([(i, "indexing" if i % 7 == 3 else "ready") for i in range(60)], "doc_id long, status string")
    queries = spark.createDataFrame([(0, "alpha beta"), (1, "gamma"), (2, "delta alpha gamma beta"), (3, "nichts")], "query_id long, query string")
    monkeypatch.setattr(P, "CELLS", 64)  # portions of few chunks, so that documents are cut
    store = P.build_store(chunks, buckets=3, block=8)
    for k, cap in ((10, 3), (7, 1), (40, None), (500, 2)):
        found = _hits(P.search_stored(queries, store, docs, k, cap))
        assert found and found == _hits(P.scan_search(queries, chunks, docs, k, cap))


def test_postings_are_dealt_once_for_all_queries(spark):
    chunks = spark.createDataFrame([(i, i, "gleich und selten") for i in range(500)], "doc_id long, chunk_id long, text string")
    docs = spark.createDataFrame([(i, "ready") for i in range(500)], "doc_id long, status string")
    queries = spark.createDataFrame([(q, "gleich selten") for q in range(50)], "query_id long, query string")
    found = P.search_stored(queries, P.build_store(chunks, buckets=2), docs, 5, 1)
    assert found.count() == 250
    plan = re.sub(r"#\d+L?", "", found._jdf.queryExecution().toString())
    # no exchange of rows by query and chunk: the scores come from the tasks that hold the parts
    assert "hashpartitioning(part" in plan and "hashpartitioning(query_id, doc_id, chunk_id" not in plan
