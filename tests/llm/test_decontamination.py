import random
import time

import numpy as np

from corvane.llm.decontamination import best_occurrence, contaminated, normalised, pieces


def slow(pattern, text):
    """Sellers' dynamic programming, a row at a time."""
    t, place = np.frombuffer(text.encode("utf-32-le"), np.uint32), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, int)
    for i, p in enumerate(pattern, 1):
        new = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (t != ord(p)))))
        row = np.minimum.accumulate(new - place) + place
    return int(row.min())


def test_bit_parallel_distance_matches_dynamic_programming():
    rng = random.Random(4)
    for _ in range(200):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 80)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 120)))
        assert best_occurrence(p, t)[0] == min(slow(p, t), len(p))


def test_pieces_cover_the_item():
    assert "".join(x for _, x in pieces("abcdefghij", 3)) == "abcdefghij" and len(pieces("abcdefghij", 3)) == 4


def test_edited_occurrences_match_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(12)]
    docs = []
    for d in range(60):
        text = list(items[rng.randrange(12)][1])
        for _ in range(rng.randrange(20)):
            at = rng.randrange(len(text))
            text[at : at + rng.randrange(2)] = rng.choice(["", "x", "xy"])
        docs.append((d, " ".join(word() for _ in range(20)) + " " + "".join(text) + "\n" + word()))
    want = {(d, i): k for d, t in docs for i, x in items if (k := slow(normalised(x), normalised(t))) <= int(len(x) * 0.05)}
    out = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.distance for r in out.collect()} == want and want
    blocks = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block=5)
    assert {(r.doc_id, r.item_id): r.distance for r in blocks.collect()} == want


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "the item text is here", 0), (3, "The  ITEM\ntext is here", 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, "the item text is here"), (2, None), (3, ""), (None, "x"), (4, "the item text is here")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()}
    assert got == {(None, 1), (None, 4), (3, 1), (3, 4)}
    assert contaminated(docs.limit(0), items).count() == 0 and contaminated(docs, items.limit(0)).count() == 0


def test_repeated_pieces_cost_one_pass(spark):
    """A piece that stands thousands of times in a text, and several blocks of items."""
    item = "the answer to the first question is written on page nine of the book " * 2
    text = item[:20] * 8000 + " and then " + item.replace("page", "pege", 1)
    items = spark.createDataFrame([(i, item if i == 3 else f"another item number {i} with some words of its own {i}") for i in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(1, text), (2, item[:20] * 4000), (None, item)], "doc_id long, text string")
    begun = time.time()
    want = {(1, 3, 1), (None, 3, 0)}
    assert {(r.doc_id, r.item_id, r.distance) for r in contaminated(docs, items).collect()} == want
    assert time.time() - begun < 30
    assert {(r.doc_id, r.item_id, r.distance) for r in contaminated(docs, items, block=500).collect()} == want


def test_nulls_empty_tables_and_ties(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "say twice now say twice now", 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, None), (2, ""), (3, "say twice now"), (4, "say twice now")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.start) for r in contaminated(docs, items).orderBy("item_id").collect()] == [(3, 3, 0), (3, 4, 0)]
    assert contaminated(docs.limit(0), items).count() == 0 and contaminated(docs, items.limit(0)).count() == 0


def test_items_with_one_id_null_ids_and_short_items(spark):
    long = [" ".join(f"{w}{i}" for i in range(8)) for w in ("apfel", "birne", "kirsche")]
    items = spark.createDataFrame([(1, long[0]), (1, long[1]), (None, long[2]), (1, long[0]), (2, "a"), (3, "haus")], "item_id long, text string")
    docs = spark.createDataFrame([(10, "x " + long[0]), (11, long[1] + " y"), (12, long[2]), (13, "banana haustier"), (14, "das haus, a"), (15, "HAUS"), (16, "xhaus haus")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.start, r.end) for r in contaminated(docs, items).collect()), key=str)
    # a letter inside a word is no occurrence; every text of an id is searched
    assert got == [(10, 1, 2, 2 + len(long[0])), (11, 1, 0, len(long[1])), (12, None, 0, len(long[2])), (14, 2, 10, 11), (14, 3, 4, 8), (15, 3, 0, 4), (16, 3, 6, 10)]
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, items, block=20).collect()} == {g[:2] for g in got}
