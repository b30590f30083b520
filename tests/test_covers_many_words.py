"""Covers are scored in the tasks however many words of the corpus match the queries."""

from corvane.operators import passages as H


def test_words_of_the_corpus_do_not_count(spark, monkeypatch):
    forms = [f"ha{'l' * (i % 9 + 1)}{e}" for i in range(60) for e in ("", "e", "en", "es", "er", "ern", "em", "est")]
    chunks = spark.createDataFrame([(i, f"{w} x {w}") for i, w in enumerate(forms)], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "hale hallen x"), (2, "halll")], "query_id long, query string")
    asked = H.query_items(q).count()
    monkeypatch.setattr(H, "SMALL_ROWS", asked)
    got = H.cover_density(q, chunks)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # the words were counted before, and too many of them were joined: a row for each place
    assert "MapInArrow" in plan and len(set(forms)) > asked
    found = sorted(map(str, got.collect()))
    monkeypatch.setattr(H, "_asked_words", lambda *a: None)
    assert found and found == sorted(map(str, H.cover_density(q, chunks).collect()))
