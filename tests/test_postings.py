import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corvane.functions.stems import with_stems
from corvane.operators import postings as P

TEXTS = "doc_id long, chunk_id long, text string"


@pytest.fixture(scope="module")
def library(spark):
    rng = random.Random(8)
    words = [f"wort{i}" for i in range(60)] + ["gemeinsam"] * 40
    rows = [(i // 4, i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))) for i in range(400)]
    rows += [(200, 900, "Die Verträge der Häuser"), (201, 901, "Ein Vertrag"), (202, 902, "two houses by the sea"), (203, 903, ""), (204, 904, None)]
    docs = spark.createDataFrame([(i, "indexing" if i % 17 == 3 else "ready") for i in range(210)], "doc_id long, status string")
    return spark.createDataFrame(rows, TEXTS).cache(), docs


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def hits(df):
    return sorted((r.query_id, r.rank, r.chunk_id, r.doc_id, round(r.score, 6)) for r in df.collect())


def test_stems(spark):
    pairs = {"verträge": ("vertrag", "verträge"), "vertrag": ("vertrag", "vertrag"), "häuser": ("hau", "häuser"), "haus": ("hau", "hau"), "kannen": ("kann", "kannen"), "schiene": ("schien", "schiene"), "gegangen": ("gang", "gegangen"), "geld": ("geld", "geld")}
    english = {"houses": "house", "running": "run", "hopping": "hop", "hoped": "hope", "caresses": "caress", "ponies": "poni", "feed": "feed", "agreed": "agree", "bled": "bled", "sized": "size", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "cities": "citi", "city": "citi", "is": "is", "": ""}
    df = with_stems(spark.createDataFrame([(w,) for w in [*pairs, *english]], "word string"))
    got = {r.word: (r.german, r.english) for r in df.collect()}
    assert {w: got[w] for w in pairs} == pairs and {w: got[w][1] for w in english} == english and df.columns == ["word", "german", "english"]


def test_search_finds_other_forms_in_both_languages(spark, library):
    chunks, docs = library
    store = P.build_store(chunks, buckets=4)
    found = hits(P.search_stored(asked(spark, "Vertrag", "house", "Verträgen", "the die", "", "unbekannt"), store, docs))
    assert {(q, c) for q, _, c, _, _ in found} == {(0, 900), (0, 901), (1, 902), (2, 900), (2, 901), (3, 900), (3, 902)}  # a stopword of one language is a word of the other
    # the short chunk first
    assert [c for q, _, c, _, _ in found if q == 0] == [901, 900]


@pytest.mark.parametrize("shard, block", [(1 << 20, 128), (50, 4), (7, 1)])
def test_stored_search_equals_the_scan(spark, library, shard, block):
    chunks, docs = library
    store = P.build_store(chunks, buckets=8, shard=shard, block=block)
    queries = asked(spark, "wort1 wort2 wort3", "gemeinsam", "gemeinsam wort5", " ".join(f"wort{i}" for i in range(30)), "Häuser")
    for k, cap in ((10, 3), (3, None), (1, 1)):
        assert hits(P.search_stored(queries, store, docs, k, cap)) == hits(P.scan_search(queries, chunks, docs, k, cap))
    frequent = store.table("words").orderBy(F.desc("df")).first()
    assert frequent.shards == -(-frequent.df // shard)


def test_blocks_below_the_kth_score_stay_packed(spark, library):
    chunks, docs = library
    store = P.build_store(chunks, buckets=4, block=4)
    found, every, kept = P._search(asked(spark, "gemeinsam"), store, docs, 3, None, None)
    assert kept.count() < every.count() / 2 and len(found.collect()) == 3


def test_only_the_terms_buckets_are_read(spark, library):
    chunks, _ = library
    store = P.build_store(chunks, buckets=16)
    files = sorted(Path(store.path.removeprefix("file:"), "blocks").glob("part-*"))
    _, blocks = P.asked_blocks(store, asked(spark, "gemeinsam"))
    whole = sorted(map(str, blocks.collect()))
    assert len(files) == 16 and whole
    used = "".join(r[0] for r in store.table("blocks").filter("term IN ('gemeinsam', 'meinsam')").select(F.input_file_name()).distinct().collect())
    for f in files:  # the others are not there when the next search reads
        if f.name not in used:
            f.rename(f.with_name("_" + f.name))
    _, blocks = P.asked_blocks(store, asked(spark, "gemeinsam"))
    assert sorted(map(str, blocks.collect())) == whole
    for f in files:
        if f.name not in used:
            f.with_name("_" + f.name).rename(f)
    # too many terms for literals: the whole index joins, with the same rows
    old, P.LITERALS = P.LITERALS, 0
    try:
        _, joined = P.asked_blocks(store, asked(spark, "gemeinsam"))
        assert sorted(map(str, joined.collect())) == sorted(map(str, blocks.select(joined.columns).collect()))
    finally:
        P.LITERALS = old


def test_opened_anew_and_narrowed(spark, library):
    chunks, docs = library
    path = P.build_store(chunks, buckets=4).path
    store = P.open_store(spark, path)
    queries = asked(spark, "gemeinsam", "wort1")
    allowed = spark.createDataFrame([(0, 5), (0, 6)], "query_id long, doc_id long")
    found = hits(P.search_stored(queries, store, docs, 10, None, allowed))
    assert {d for q, _, _, d, _ in found if q == 0} <= {5, 6} and {d for q, _, _, d, _ in found if q == 1} - {5, 6}


def test_empty_library(spark):
    store = P.build_store(spark.createDataFrame([], TEXTS), buckets=2)
    docs = spark.createDataFrame([(1, "ready")], "doc_id long, status string")
    assert P.search_stored(asked(spark, "haus"), store, docs).count() == 0
    assert P.search_stored(spark.createDataFrame([], "query_id long, query string"), store, docs).count() == 0


def test_stems_of_the_tasks_equal_those_of_the_columns(spark):
    from corvane.functions.stems import stems

    rng = random.Random(11)
    parts = ["ge", "sch", "ei", "ie", "ss", "ed", "eed", "ing", "ies", "sses", "at", "bl", "iz", "y", "em", "er", "nd", "t", "e", "s", "n", "ä", "ß", "oo", "ll", "b", "r", "a", "7", "77"]
    words = sorted({"".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(6000)})
    got = {r.word: (r.german, r.english) for r in with_stems(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert {w: stems(w) for w in words} == got


def test_postings_are_shuffled_as_lists(spark, library, monkeypatch):
    chunks, _ = library
    lists, sent = P._lists, []

    def counting(shards):
        run = lists(shards)
        sent.append(chunks.select("doc_id", "chunk_id", F.lower("text").alias("text")).mapInArrow(run, P._LISTS).count())
        return run

    monkeypatch.setattr(P, "_lists", counting)
    # rows that repeat an id are one chunk, as in the scan
    for some in (chunks, chunks.unionByName(chunks.filter("chunk_id < 9").withColumn("text", F.lit("Gemeinsam wort7 Häuser")))):
        want = sorted((r.term, r.doc_id, r.chunk_id, round(r.tf, 6), round(r.len, 6)) for r in P.weighted_postings(some).collect())
        store = P.build_store(some, buckets=3, shard=30, block=8)
        rows = store.table("blocks").select("term", F.inline("postings")).collect()
        assert sorted((r.term, r.doc_id, r.chunk_id, r.tf / 5, r.len / 5) for r in rows) == want
    # far fewer rows than postings before: one a posting
    assert sent[0] < len(want) / 4
