"""Steps whose rows have to stay in proportion to the input."""

import random

import pandas as pd
from pyspark.sql import functions as F

from corvane.operators import chunking as C
from corvane.operators import citations as L
from corvane.operators import languages as G
from corvane.plans import q_search, views


def brute_targets(queries, titles, least=0.5, margin=2.0):
    out = {}
    for i, q in queries:
        own = {w for w in q.split() if w != "summarize"}
        found = sorted(((-len(own & set(t.split())) / len(set(t.split())), d) for d, t in titles if own & set(t.split())))
        best, second = (-found[0][0] if found else 0.0), (-found[1][0] if len(found) > 1 else None)
        kind = "none" if best < least else "ambiguous" if second is not None and best < second * margin else "resolved"
        out[i] = (kind, found[0][1] if kind == "resolved" else None)
    return out


def test_targets_with_frequent_title_words_by_brute_force(spark):
    rng = random.Random(3)
    words = ["plan"] * 6 + ["report"] * 4 + ["budget"] * 2 + [f"w{i}" for i in range(12)]
    titles = [(d, " ".join(dict.fromkeys(rng.choice(words) for _ in range(rng.randrange(1, 5))))) for d in range(60)] + [(90, "plan x1 x2"), (91, "x3 x4")]
    queries = [(i, "summarize " + " ".join(rng.choice(words + ["x1", "x2", "x3"]) for _ in range(rng.randrange(0, 5)))) for i in range(120)] + [(500, "summarize x3 x4"), (501, "summarize plan x1 x2")]
    q, t = spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(titles, "doc_id long, title string")
    want = brute_targets(queries, titles)
    assert {k for k, _ in want.values()} == {"none", "ambiguous", "resolved"}
    for rare in (0, 3, 64):
        assert {r.query_id: (r.kind, r.doc_id) for r in L.resolve_target_document(q, t, rare=rare).collect()} == want


def test_a_word_of_all_titles_pairs_no_query_with_every_title(spark):
    n = 20_000
    t = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("src "), F.col("id").cast("string")).alias("title"))
    q = spark.range(n).select(F.col("id").alias("query_id"), F.concat(F.lit("summarize src "), F.col("id").cast("string")).alias("query"))
    # 400 million pairs before
    got = L.resolve_target_document(q, t).agg(F.count("*"), F.count_if(F.col("kind") == "ambiguous"), F.count("doc_id")).first()
    assert tuple(got) == (n, 0, n)


def test_language_is_detected_in_bounded_portions(spark, monkeypatch):
    learnt = spark.createDataFrame([("x", "aaa bbb"), ("y", "ccc ddd")], "lang string, text string")
    detect = G.detector(G.learn_profiles(learnt)).func
    texts = pd.Series([None, "aaa " * 20, "", "ccc " * 30, "x", "aaa " * 5000] * 40)
    whole, sizes, plain = detect(texts), [], G.ngrams
    monkeypatch.setattr(G, "ngrams", lambda some: sizes.append(sum(len(t or "") for t in some)) or plain(some))
    monkeypatch.setattr(G.portions, "__defaults__", (1000,))
    parts = detect(texts)
    assert parts.equals(whole) and len(parts) == len(texts) and set(parts["language"].dropna()) == {"x", "y"}
    # of 800,000 characters a text, or a thousand in several, at a time
    assert max(sizes) == 20_000 and sum(sizes) == sum(len(t or "") for t in texts)


def test_units_of_many_documents_take_no_group_each(spark):
    n = 3000
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("id") % 7)).alias("ordinal"))
    chunks = rows.select("doc_id", "ordinal", F.when(F.col("ordinal") == 3, "\x1c ").otherwise("words").alias("text"), (F.col("ordinal") * 300 + 100).alias("token_count"), F.concat(F.lit("t"), "doc_id").alias("title"), F.when(F.col("ordinal") > 1, F.array(F.concat(F.lit("S"), F.floor(F.col("ordinal") / 4).cast("string")), F.concat(F.lit("P"), F.col("ordinal").cast("string")))).alias("heading_path"))
    built = C.build_units(chunks)
    assert "FlatMapGroups" not in built._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in built.collect():
        got.setdefault(r.doc_id, []).append((r.unit, r.title, r.tokens, r.first_ordinal, r.last_ordinal, r.n_chunks))
    assert len(got) == n
    for d, units in got.items():
        own = [k for k in range(d % 7 + 1) if k != 3]
        number = C.unit_numbers(C.np.array([k * 300 + 100 for k in own]), [f"S{k // 4}" if k > 1 else None for k in own])
        want = []
        for u in sorted(set(number.tolist())):
            mine = [k for k, m in zip(own, number, strict=True) if m == u]
            want.append((u, f"P{mine[-1]}" if mine[-1] > 1 else f"t{d}", sum(k * 300 + 100 for k in mine), mine[0], mine[-1], len(mine)))
        assert sorted(units) == want


def test_overlaps_shuffle_the_two_texts_of_a_pair_only(spark):
    snippets = spark.createDataFrame([(1, 7, "one two three four"), (2, 7, "Frontier"), (3, 7, "a b c"), (4, 8, "x"), (5, 9, None)], "snippet_id long, chunk_id long, snippet string")
    chunks = spark.createDataFrame([(7, "One, two three; four - a b c. FRONTIER land"), (8, None), (9, "x y")], "chunk_id long, text string")
    found = L.shingle_overlap(snippets, chunks)
    assert sorted(map(tuple, found.collect())) == [(1, 7, 0, 20), (2, 7, 30, 38)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Window" not in plan and "Aggregate" not in plan


def test_texts_of_hits_are_cut_from_their_documents_only(spark, sf):
    plan = q_search._weighable(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    # the generator that cuts chunks stands above the join that leaves the hits' documents
    assert "LeftSemi" in plan and plan.index("Generate") < plan.rindex("LeftSemi")
    only = spark.createDataFrame([(3,), (5,)], "doc_id long")
    every = views.chunks(spark, sf).filter("doc_id IN (3, 5)")
    assert sorted(map(tuple, views.chunks(spark, sf, only).collect())) == sorted(map(tuple, every.collect()))
