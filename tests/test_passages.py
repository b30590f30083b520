import itertools
import random

import pytest

from corvane.operators import passages as H


def brute_covers(positions, items):
    need, n = set(items), len(positions)
    spans = {(a, b) for a in positions for b in positions if a <= b and {i for p, i in zip(positions, items, strict=True) if a <= p <= b} == need}
    return sorted(s for s in spans if not any(t != s and t[0] >= s[0] and t[1] <= s[1] for t in spans)) if n else []


def test_minimal_covers_by_brute_force():
    rng = random.Random(2)
    for _ in range(1500):
        hits = sorted({(rng.randrange(14), rng.choice("abcd"[: rng.randrange(1, 5)])) for _ in range(rng.randrange(1, 12))})
        positions, items = [p for p, _ in hits], [i for _, i in hits]
        assert H.minimal_covers(positions, items) == brute_covers(positions, items)


def test_cover_scores():
    assert H.minimal_covers([1, 4, 6, 7], "abab") == [(1, 4), (4, 6), (6, 7)]
    assert H.cover_score([1, 2], "ab", [1.0, 1.0]) == 1.0
    # two other words between: a third; the weaker match counts by the harmonic mean
    assert H.cover_score([1, 4], "ab", [1.0, 1.0]) == pytest.approx(1 / 3)
    assert H.cover_score([1, 2], "ab", [1.0, 0.4]) == pytest.approx(2 / 3.5)
    assert H.cover_score([3, 9], "aa", [1.0, 1.0]) == 2.0


def test_cover_density(spark):
    chunks = spark.createDataFrame([(1, "Der Vertrag und die Kündigung"), (2, "Verträge gibt es viele, eine Kündigung selten"), (3, "Kündigung"), (4, "nichts"), (5, None)], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "Vertrag Kündigung"), (2, "")], "query_id long, query string")
    got = {r.chunk_id: r for r in H.cover_density(q, chunks).collect()}
    assert set(got) == {1, 2, 3} and got[1].score == pytest.approx(1 / 3) and got[2].score == pytest.approx(1 / 5) and got[3].score == 0.5
    strict = {r.chunk_id: r.score for r in H.cover_density(q, chunks, "all").collect()}
    assert strict[1] > strict[2] > strict[3] == 0
    with pytest.raises(ValueError):
        H.cover_density(q, chunks, "some")


def most_matches(matches, n, most):
    windows = [(a, min(a + most, n)) for a in range(n)]
    best = max((sum(a <= m < b for m in set(matches)) for a, b in windows), default=0)
    for (a, b), (c, d) in itertools.combinations(windows, 2):
        if b <= c:
            best = max(best, sum(a <= m < b or c <= m < d for m in set(matches)))
    return best


def test_fragments_by_brute_force():
    rng = random.Random(5)
    for _ in range(600):
        n, most = rng.randrange(1, 30), rng.randrange(2, 9)
        least = rng.randrange(1, most + 1)
        matches = sorted(rng.sample(range(n), rng.randrange(0, min(n, 8) + 1)))
        found = H.fragments(matches, n, least, most)
        assert sum(a <= m < b for m in matches for a, b in found) == most_matches(matches, n, most)
        assert all(0 <= a < b <= n and b - a <= most for a, b in found) and all(b <= c for (_, b), (c, _) in itertools.pairwise(found))
        assert all(b - a >= min(least, n) or len(found) == 2 for a, b in found) and all(any(a <= m < b for m in matches) for a, b in found)
        if len(found) == 2:
            assert max(sum(a <= m < a + most for m in matches) for a in range(n)) < len(matches)


def test_fragments_of_a_long_text_are_quick():
    import time

    began = time.time()
    assert len(H.fragments(range(0, 400_000, 3), 400_000, 6, 18)) == 2
    assert time.time() - began < 5


def test_headlines(spark):
    text = "vorne " * 30 + "die Verträge sind alt " + "mitte " * 40 + "ein Vertrag endet " + "ende " * 30
    hits = spark.createDataFrame([(1, 1, text, "de"), (1, 2, "nothing  to\nsee " * 40, "en"), (2, 3, "Many houses, and one house's roof", "en"), (2, 4, None, None), (1, 5, "Vertrag", "de")], "query_id long, chunk_id long, text string, language string")
    queries = spark.createDataFrame([(1, "Vertrag"), (2, "house")], "query_id long, query string")
    got = {r.chunk_id: r.headline for r in H.headlines(hits, queries).collect()}
    assert got[1] == "⟦Verträge⟧ sind alt mitte mitte mitte … ⟦Vertrag⟧ endet ende ende ende ende"
    assert got[2] == ("nothing to see " * 40)[:240] and got[3] == "Many ⟦houses,⟧ and one ⟦house's⟧ roof"[0:] and got[4] == "" and got[5] == "⟦Vertrag⟧"


def test_cover_scores_of_many_groups_at_once():
    import numpy as np

    rng, rows = random.Random(4), []
    for group in range(400):
        hits = sorted({(rng.randrange(14), rng.randrange(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 12))})
        rows += [(group * 3, p, i, rng.choice((1.0, 0.4))) for p, i in hits]
    group, position, item, weight = (np.array(c) for c in zip(*rows, strict=True))
    first, items, scores = H.cover_scores(group, position, item, weight)
    want = [[r[1:] for r in rows if r[0] == g] for g in sorted(set(group.tolist()))]
    assert items.tolist() == [len({i for _, i, _ in x}) for x in want] and group[first].tolist() == sorted(set(group.tolist()))
    assert scores.tolist() == [H.cover_score(*zip(*x, strict=True)) for x in want]


def test_covers_in_the_tasks_equal_those_of_the_join(spark, monkeypatch):
    rng = random.Random(6)
    words = ["Vertrag", "Verträge", "Häuser", "houses", "house", "the", "die", "running", "runs", "x"]
    rows = [(i if i < 60 else i % 7, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for i in range(70)] + [(None, "house"), (None, "x house"), (99, None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string").repartition(3)
    q = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 6)))) for i in range(20)], "query_id long, query string")
    monkeypatch.setattr(H, "AT_ONCE", 50)
    got = H.cover_density(q, chunks)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    rows_of = lambda df: sorted(map(str, df.collect()))
    found = rows_of(got)
    monkeypatch.setattr(H, "_asked_words", lambda *a: None)
    assert found and found == rows_of(H.cover_density(q, chunks))
