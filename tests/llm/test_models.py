import random
from collections import Counter
import re

import numpy as np
from pyspark.sql import functions as F

from corvane.llm.io import crc_mod, table
from corvane.llm.language import fit_language, identify_language, op8_language_id
from corvane.llm.quality import LineField, fit_lines, op9_quality_rules, rate_quality, train_field, viterbi
from corvane.llm.toxicity import ToxicityModel, fit_noisy_or, fit_toxicity, labelled_documents, op4_toxicity, score_toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        bad = i % 3 == 0
        sentences = [" ".join(word() for _ in range(8)) + "." for _ in range(6)]
        if bad:
            sentences[rng.randrange(6)] = f"{word()} {rng.choice(['scoundrelly', 'scoundrelo', 'blockhead'])} {word()}."
        rows.append((i, " ".join(sentences), int(bad)))
    return rows


def test_toxicity_learns_from_document_labels_and_locates_sentences(spark):
    df = spark.createDataFrame(corpus(400, 1), "doc_id long, text string, toxic int")
    model = fit_toxicity(df)
    held = spark.createDataFrame(corpus(150, 2), "doc_id long, text string, toxic int")
    out = score_toxicity(held, model).collect()
    right = sum((r.toxicity.score >= 0.5) == bool(r.toxic) for r in out)
    assert right >= 145
    hit = next(r for r in out if r.toxic and r.toxicity.sentences)
    assert any("scoundrel" in hit.text[s.start : s.end] or "blockhead" in hit.text[s.start : s.end] for s in hit.toxicity.sentences)
    assert [r.toxicity.score for r in score_toxicity(held, fit_toxicity(df)).collect()] == [r.toxicity.score for r in out]


def test_toxicity_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (3, "...", "t"), (4, "word " * 100000, "t")], "doc_id long, text string, toxicity string")
    none = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), -30.0)
    assert all(r.toxicity.score < 1e-6 for r in score_toxicity(df, none).collect())
    assert fit_toxicity(df.limit(0).selectExpr("doc_id", "text", "1 AS toxic")).features.size == 0
    assert score_toxicity(df.limit(0), none).count() == 0


def test_noisy_or_prefers_the_feature_of_positive_bags():
    docs = [(1, [0, 1], [0, 1]), (0, [0], [1]), (1, [1], [0]), (0, [], [])] * 10
    weights, bias = fit_noisy_or(docs, 2)
    assert weights[0] > 2 and weights[0] > weights[1] and bias < 0


def test_toxicity_query(spark, sf):
    out = op4_toxicity(spark, sf)
    assert out.count() == 200 and {"doc_id", "held_out", "score", "predicted"} <= set(out.columns)


SF_LARGER = "/root/testdata/sf0.01"


def test_toxicity_held_out_and_lengths(spark):
    """By labels of the held-out fifth; repeating a text changes nothing, long clean texts stay clean."""
    SF_LARGER = "/root/testdata/sf0.1"  # with a hundred toxic ones held out
    labels = table(spark, SF_LARGER, "labels").select("doc_id", "toxic")
    docs = table(spark, SF_LARGER, "documents")
    out = op4_toxicity(spark, SF_LARGER)
    rows = out.join(labels, "doc_id").join(docs.select("doc_id", F.size(F.split("text", " ")).alias("words")), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    toxic, clean = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic) and sum(r.predicted for r in clean) <= 0.02 * len(clean)
    long = [r for r in rows if not r.toxic and r.words > 2000]
    assert len(long) > 10 and sum(r.predicted for r in long) <= 0.1 * len(long)
    assert all((r.predicted == 1) == bool(r.sentences) for r in out.collect())
    model = fit_toxicity(labelled_documents(spark, docs, SF_LARGER))
    once = docs.filter("length(text) < 2000 AND doc_id % 10 = 0").select("doc_id", F.concat("text", F.lit("\n")).alias("text"))
    scores = lambda df: {r.doc_id: r.toxicity.score for r in score_toxicity(df, model).collect()}
    assert scores(once) == scores(once.withColumn("text", F.repeat("text", 50)))


def test_language_held_out_accuracy(spark, sf):
    out = op8_language_id(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.9 * len(out)


def test_language_edge_cases(spark, sf):
    model = fit_language(table(spark, sf, "documents"), epochs=2)
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 → €", "x"), (4, "é", "x"), (5, "the " * 100000, "x")], "doc_id long, text string, language string")
    got = [r.language.lang for r in identify_language(df, model).collect()]
    assert got[:3] == ["und"] * 3 and all(x in model.languages for x in got[3:])
    none = fit_language(table(spark, sf, "documents").limit(0))
    assert {r.language.lang for r in identify_language(df, none).collect()} == {"und"}


def measures(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = [False] * len(w)
    for i in range(len(w) - 7):
        if c[tuple(w[i : i + 8])] > 1:
            hit[i : i + 8] = [True] * 8
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, sum(hit)


def test_quality_measures_match_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    for r in op9_quality_rules(spark, sf).collect():
        want = measures(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)


def test_quality_verdict_on_held_out_labels(spark):
    """A field that never saw a fifth of the labels keeps its good documents and drops its bad ones."""
    docs = table(spark, SF_LARGER, "documents").select("doc_id", "text")
    labels = table(spark, SF_LARGER, "labels").select("doc_id", "quality")
    known = docs.join(labels, "doc_id").withColumn("held", crc_mod(F.col("doc_id"), 5) == 0)
    field = fit_lines(known.filter("NOT held").drop("held"))
    rows = rate_quality(known.filter("held").withColumnRenamed("quality", "label"), field).collect()
    judged = [r for r in rows if not r.quality.base_failed]
    good, bad = [r for r in judged if r.label == 1], [r for r in judged if r.label == 0]
    assert len(good) > 30 and sum(r.quality.kept for r in good) >= 0.95 * len(good)
    assert bad and sum(not r.quality.kept for r in bad) >= 0.7 * len(bad)


def test_quality_edge_cases(spark):
    field = LineField(np.zeros(11), np.array([0.0, 1.0]), np.zeros((2, 2)))
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a b\na b\n\n", 0), (4, "ä " * 100000, 0)], "doc_id long, text string, quality int")
    got = [r.quality for r in rate_quality(df, field).collect()]
    assert [g.n_words for g in got] == [0, 0, 4, 100000] and got[2].n_dup_lines == 1 and got[3].word_chars == 100000 and not got[0].kept
    assert rate_quality(df.limit(0), field).count() == 0


def test_viterbi_finds_the_best_sequence():
    rng = np.random.default_rng(0)
    field = LineField(rng.normal(size=3), rng.normal(size=2), rng.normal(size=(2, 2)))
    rows = np.repeat([0, 1, 3], [5, 1, 7])
    x = rng.normal(size=(13, 3))
    states = viterbi(field, rows, x, 4)
    for d in (0, 1, 3):
        e = x[rows == d] @ field.weights
        best = max(range(2 ** len(e)), key=lambda b: sum(e[i] * (b >> i & 1) for i in range(len(e))) + field.start[b & 1] + sum(field.step[b >> i & 1, b >> i + 1 & 1] for i in range(len(e) - 1)))
        assert [best >> i & 1 for i in range(len(e))] == states[rows == d].tolist()


def test_field_learns_lines():
    rng = np.random.default_rng(1)
    rows = np.repeat(np.arange(60), 6)
    y = rng.integers(0, 2, 360)
    x = np.stack([np.ones(360), y + rng.normal(0, 0.2, 360)], axis=1)
    field = train_field(rows, x, y, 60)
    assert (viterbi(field, rows, x, 60) == y).mean() > 0.95
