import random

from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import citations as L
from corvane.operators import evaluation as M
from corvane.operators import fusion as G
from corvane.operators import lexical as E
from corvane.operators import maintenance as B
from corvane.operators import relational as K
from corvane.operators import vectors as V


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("x")).first().x


def test_rrf_and_ties(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id long, chunk_id long, rank int")
    b = spark.createDataFrame([(1, 12, 1), (1, 10, 2), (1, 13, 3)], "query_id long, chunk_id long, rank int")
    rows = G.rrf_fuse([a, b], 10).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == [10, 12, 11, 13]
    assert abs(rows[0].score - (1 / 61 + 1 / 62)) < 1e-12
    assert [r.chunk_id for r in G.rrf_fuse_variants([a, b], 10).orderBy("rank").collect()] == [r.chunk_id for r in rows]


def test_round_robin_equals_the_loop(spark):
    rng = random.Random(0)
    hits = [(q, r, q * 100 + r, rng.randrange(4)) for q in range(6) for r in range(1, rng.randrange(3, 14))]
    df = spark.createDataFrame(hits, "query_id long, rank int, chunk_id long, doc_id long")
    got = {}
    for r in G.diversify_by_document(df, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    for q in range(6):
        mine = [h for h in hits if h[0] == q]
        if len(mine) > 5:
            lists = {}
            for h in mine:
                lists.setdefault(h[3], []).append(h[2])
            want = []
            while len(want) < 5:
                for d in lists:
                    if lists[d]:
                        want.append(lists[d].pop(0))
            assert got[q] == want[:5]
        else:
            assert got[q] == [h[2] for h in mine]


def test_factors(spark):
    hit = spark.createDataFrame([(1, 1, 5, 2.0, "Weekly report.pdf", "the report", "short", 100, "de")], "query_id long, rank int, chunk_id long, score double, title string, query string, text string, added_at long, language string")
    assert abs(G.apply_heuristics(hit, 200, "de").first().score - 2 * 1.25 * 0.7 * 1.1 * 1.1) < 1e-9
    assert G.apply_heuristics(hit, 10**6, None, title=1.0, short=0.0).first().score == 2.0


def test_trimming_drops_neighbours_first_and_keeps_one(spark):
    rows = [(1, 1, 10, "primary", 50), (1, 2, 11, "neighbour", 50), (1, 3, 12, "whole_doc", 50), (1, 4, 13, "primary", 50)]
    df = spark.createDataFrame(rows, "query_id long, rank int, chunk_id long, origin string, chars int")
    left = lambda n: [r.chunk_id for r in G.trim_to_char_budget(df, n).orderBy("rank").collect()]
    assert left(200) == [10, 11, 12, 13] and left(150) == [10, 12, 13] and left(100) == [10, 13] and left(60) == [10] and left(1) == [10]


def test_packing_keeps_the_first(spark):
    df = spark.createDataFrame([(1, 1, 2, 3, "T", "x" * 400), (1, 2, 2, 4, "T", "y" * 40)], "query_id long, rank int, doc_id long, chunk_id long, title string, text string")
    assert G.pack_to_token_budget(df, 10).count() == 1 and G.pack_to_token_budget(df, 10**6).count() == 2
    assert G.pinned_budget(8192, 1) == 3276 and G.pinned_budget(10**6, 2) == 4096 and G.pinned_budget(100, 0) == 0


def test_routing(spark):
    assert one(spark, X.query_breadth, "Please summarize this") == "summary" and one(spark, X.query_breadth, "Gib mir eine Übersicht") == "summary"
    assert one(spark, X.query_breadth, "list all dates") == "broad" and one(spark, X.query_breadth, "who wrote it?") == "focused"
    assert one(spark, X.corpus_intent, "how many of my documents cover x") == "count" and one(spark, X.corpus_intent, "how many documents does chapter 3 mention") is None
    assert one(spark, X.corpus_intent, "welche Dateien habe ich") == "list"
    assert one(spark, X.split_questions, "What is a lens? And how does it bend light? ok?") == ["What is a lens?", "And how does it bend light?"]
    assert one(spark, X.theme_tokens, "wie viele dokumente habe ich zu strom und spannung") == ["strom", "spannung"]
    assert one(spark, X.guess_de_en, "was ist das") == "de" and one(spark, X.guess_de_en, "what is this") == "en"


def test_cleaning(spark):
    assert one(spark, X.clean_page_text, "Intro ........ 4\nname ____ x  y \nz") == "Intro 4\nname x y\nz"
    assert one(spark, X.clean_extract, "a\r\nb  \n\n\n\nc\nReferences \nz") == "a\nb\n\nc"
    assert one(spark, X.clean_rewrite, '\n "Query: find me"\nmore') == "find me" and one(spark, X.clean_rewrite, "") == ""
    assert one(spark, X.strip_think, "<think>a\nb</think> hi ") == "hi"
    assert one(spark, lambda c: X.condense(c, 5), "a  b   cdef") == "a b …"
    assert one(spark, X.model_stem, "hub://org/Model-X-GGUF:q4") == "model-x"
    assert one(spark, X.classify_doc_type, "a.b/File.TS") == "code" and one(spark, X.classify_doc_type, "a.b/file") == "txt"
    assert one(spark, X.mime_from_ext, "x.bin") is None


def test_citations(spark):
    df = spark.createDataFrame([(1, "Äx [doc:1, chunk:2]. Then [doc:3,chunk:4], [doc:1, chunk:2].")], "message_id long, content string")
    rows = L.extract_citations(df).orderBy("seq").collect()
    text = df.first().content
    assert [(r.doc_id, r.chunk_id) for r in rows] == [(1, 2), (3, 4), (1, 2)] and all(text[r.start : r.end].startswith("[doc:") and text[r.end - 1] == "]" for r in rows)
    assert {(r.doc_id, r["index"]) for r in L.number_citations(L.extract_citations(df)).collect()} == {(1, 1), (3, 2)}


def test_snippets_step_back_to_words(spark):
    df = spark.createDataFrame([(1, "The claim stands. [doc:1, chunk:2], [doc:3, chunk:4].")], "message_id long, content string")
    got = {(r.doc_id, r.snippet) for r in L.citation_snippets(df).collect()}
    assert got == {(1, "The claim stands."), (3, "The claim stands.")}


def test_shingle_spans(spark):
    chunks = spark.createDataFrame([(7, "Alpha beta gamma delta, epsilon zeta. Frontier land.")], "chunk_id long, text string")
    snippet = lambda s: [(r.start, r.end) for r in L.shingle_overlap(spark.createDataFrame([(1, 7, s)], "snippet_id long, chunk_id long, snippet string"), chunks).collect()]
    assert snippet("x alpha BETA gamma y") == [(0, 16)]
    assert snippet("uses the frontier now") == [(38, 46)]
    assert snippet("nothing here matches") == []


def test_literal_spans_and_segments(spark):
    df = spark.createDataFrame([(1, "aXa.xa", " xa ")], "id long, text string, needle string")
    spans = L.literal_spans(df, "id", "text", "needle")
    assert sorted((r.start, r.end) for r in spans.collect()) == [(1, 3), (4, 6)]
    parts = L.apply_spans(df, spans, "id", "text").orderBy("start").collect()
    assert [(r.part, r.highlighted) for r in parts] == [("a", False), ("Xa", True), (".", False), ("xa", True)]


def test_questions_and_scores(spark):
    assert K.json_objects('Sure: [{"a": "}"}, {"b": {"c": 1}}, {"d": ') == ['{"a": "}"}', '{"b": {"c": 1}}']
    assert K.json_objects('{"a": 1} {bad} {"c": 2}') == ['{"a": 1}']
    q = spark.createDataFrame([(1, 0, 0, 1, "A?"), (1, 0, 1, 2, "a"), (1, 1, 0, 3, "A!"), (1, 1, 1, 4, "b")], "deck_id long, unit long, seq long, question_id long, stem string")
    assert sorted(r.question_id for r in K.dedup_stems(q).collect()) == [1, 4]
    assert sorted(r.question_id for r in K.dedup_stems(q, cap=1).collect()) == [1, 4]


def test_speakers(spark):
    s = spark.createDataFrame([(1, 1, 0.0, 4.0), (1, 2, 10.0, 11.0), (1, 3, 20.0, 21.0), (2, 1, 0.0, 1.0)], "recording long, seg long, start double, end double")
    t = spark.createDataFrame([(1, 1, 0, 0.0, 2.0), (1, 2, 1, 2.0, 4.0), (1, 3, 2, 12.0, 14.0)], "recording long, turn long, speaker long, start double, end double")
    got = {(r.recording, r.seg): r.label for r in K.assign_speakers(s, t).collect()}
    assert got == {(1, 1): "Speaker 1", (1, 2): "Speaker 3", (1, 3): "Speaker 3", (2, 1): None}


def test_metrics(spark):
    q = spark.createDataFrame([("c", 1, [1, 2], [1, 2, 3, 4], 1), ("c", None, [9], [], 9), ("c", 2, None, None, 5)], "config string, rank int, retrieved array<long>, required array<long>, expected long")
    r = M.eval_report(q).first()
    assert r.recall_at_1 == 1 / 3 and r.mrr == 0.5 and abs(r.recall_required_at_5 - 0.5 / 3) < 1e-12


def test_floor_percentile(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(1, 11)], "k string, v double")
    r = M.latency_summary(df, ["k"], "v").first()
    assert (r.n, r.p50, r.p95, r.max) == (10, 6.0, 10.0, 10.0)


def test_chrf_invariants(spark):
    rows = [("same", 1, "the cat sat", "the cat sat"), ("none", 1, "abc", "xyz"), ("empty", 1, "", ""), ("spaces", 1, "a b", "a  b"), ("cyr", 1, "привет мир", "привет мир")]
    got = {r.direction: r.chrf for r in M.chrf(spark.createDataFrame(rows, "direction string, segment long, hyp string, ref string"), ["direction"]).collect()}
    assert got["same"] == 100 and got["none"] == 0 and got["empty"] == 0 and got["cyr"] == 100 and got["spaces"] == 100


def test_reconcile(spark):
    inv = spark.createDataFrame([(1, "/a/new", 1, "h"), (1, "/a/same", 1, "h"), (1, "/a/touch", 2, "h"), (1, "/a/edit", 2, "i")], "workspace_id long, source_path string, mtime long, content_hash string")
    doc = spark.createDataFrame([(1, "/a/same", 1, "h", None), (1, "/a/touch", 1, "h", None), (1, "/a/edit", 1, "h", None), (1, "/a/gone", 1, "h", None), (1, "/b/gone", 1, "h", None), (1, "/A/lost", 1, "h", 5), (1, "/ab/x", 1, "h", None)], "workspace_id long, source_path string, mtime long, content_hash string, missing_at long")
    roots = spark.createDataFrame([(1, "/a/")], "workspace_id long, path string")
    got = {r.source_path: (r.action, r.touch) for r in B.reconcile_inventory(inv, doc, roots).collect()}
    assert got == {"/a/new": ("imported", False), "/a/same": ("unchanged", False), "/a/touch": ("unchanged", True), "/a/edit": ("reindexed", False), "/a/gone": ("marked_missing", False), "/b/gone": ("untouched", False), "/A/lost": ("still_missing", False), "/ab/x": ("untouched", False)}


def test_append_messages_rejects_roles(spark):
    m = spark.createDataFrame([(1, "user")], "id long, role string")
    good, bad = B.append_messages(m, spark.createDataFrame([(2, "assistant"), (3, "robot"), (4, None)], "id long, role string"))
    assert good.count() == 2 and bad.count() == 2


def test_knn_blocks_and_nulls(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(99, None), (98, [0.0] * 8)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.filter("vec_id < 10").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    whole = {(r.query_id, r.rank): r.vec_id for r in V.knn_exact(q, v, 5).collect()}
    monkeypatch.setattr(V, "QUERY_BYTES", 100)
    assert {(r.query_id, r.rank): r.vec_id for r in V.knn_exact(q, v, 5).collect()} == whole
    assert all(whole[(i, 1)] == i for i in range(10))


def test_sentinels(spark):
    parts = E.split_sentinels(spark.createDataFrame([(1, "⟦a⟧ b ⟦⟧c")], "id long, t string"), "id", "t").orderBy("seq").collect()
    assert [(r.part, r.highlighted) for r in parts] == [("a", True), (" b ", False), ("c", False)]


def test_models_plug_in(spark):
    import pandas as pd

    from corvane.operators import models as U

    @F.pandas_udf("double")
    def score(q: pd.Series, t: pd.Series) -> pd.Series:
        return (q.str.len() - t.str.len()).astype(float)

    pairs = spark.createDataFrame([(1, 2, "abc", "a")], "query_id long, chunk_id long, query string, text string")
    assert U.with_pair_scorer(pairs, score).first().pair_score == 2.0
