"""Queries that SQL can't say, or not well, against plain Python on the small tables, and literal cases."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.operators import chunking as C
from corvane.operators import relational as K
from corvane.plans import q_corpus, q_eval, q_tables, registry
from corvane.plans.views import chunks
from corvane.sources import files as A


def counts(text, kind, n):
    if kind == "c":
        bare = re.sub(r"\s+", "", text)
        return Counter(bare[i : i + n] for i in range(len(bare) - n + 1))
    words = text.split()
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def chrf(pairs):
    """chrF++ of (hypothesis, reference) pairs pooled: six orders of characters, two of words, recall twice as heavy."""
    scores = []
    for kind, n in [*(("c", n) for n in range(1, 7)), ("w", 1), ("w", 2)]:
        h = r = both = 0
        for hyp, ref in pairs:
            a, b = counts(hyp, kind, n), counts(ref, kind, n)
            h, r, both = h + sum(a.values()), r + sum(b.values()), both + sum((a & b).values())
        if h or r:
            p, q = both / max(h, 1), both / max(r, 1)
            scores.append(5 * p * q / (4 * p + q) if both else 0.0)
    return 100 * sum(scores) / len(scores) if scores else 0.0


def test_chrf_and_direction_summary(spark, sf):
    rows, took = defaultdict(list), defaultdict(list)
    for r in q_eval._segments(spark, sf).collect():
        rows[r.direction].append((r.hyp or "", r.ref or ""))
        took[r.direction].append(r.ms)
    want = {d: chrf(p) for d, p in rows.items()}
    got = {r.direction: r.chrf for r in registry.QUERIES["chrf"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d], abs=1e-5) for d in want)
    for r in registry.QUERIES["direction_summary"](spark, sf).collect():
        assert r.n == len(rows[r.direction]) and r.chrf == pytest.approx(want[r.direction], abs=0.006) and r.mean_ms == pytest.approx(sum(took[r.direction]) / r.n, abs=0.51)


def test_chrf_literals():
    assert chrf([("a b c d e f g h", "abcdefgh")]) == pytest.approx(75) and chrf([("xxxxx yyyyy", "aaaaa bbbbb")]) == 0


def test_dedup_stems(spark, sf):
    decks = defaultdict(lambda: defaultdict(list))
    for r in q_tables._stems(spark, sf).collect():
        key = re.sub(r"[\W_]+", " ", r.stem.lower()).strip()
        decks[r.deck_id][r.unit].append((r.seq, r.question_id, key))
    want = set()
    for units in decks.values():
        seen = set()
        for unit in sorted(units):
            kept = 0
            for _, question, key in sorted(units[unit]):
                if kept < K.PER_UNIT and key not in seen:
                    seen.add(key)
                    want.add(question)
                    kept += 1
    assert {r.question_id for r in registry.QUERIES["dedup_stems"](spark, sf).collect()} == want


def test_unit_grounding(spark, sf):
    text = {(r.doc_id, r.ordinal): (r.chunk_id, r.text) for r in chunks(spark, sf).collect()}
    want = {}
    for u in q_corpus.build_units(spark, sf).collect():
        lines = [f"[chunk:{c}] " + re.sub(r"\s+", " ", t).strip() for o in range(u.first_ordinal, u.last_ordinal + 1) if (u.doc_id, o) in text for c, t in [text[u.doc_id, o]]]
        want[u.doc_id, u.unit] = "\n".join(lines)
    assert {(r.doc_id, r.unit): r.grounding for r in registry.QUERIES["unit_grounding"](spark, sf).collect()} == want


def test_units_hold_every_chunk_once(spark, sf):
    seen = defaultdict(list)
    for u in q_corpus.build_units(spark, sf).collect():
        seen[u.doc_id] += range(u.first_ordinal, u.last_ordinal + 1)
        assert u.tokens <= C.UNIT_MOST or u.n_chunks == 1 or u.tokens < C.UNIT_MOST + C.UNIT_LEAST
    have = defaultdict(set)
    for r in chunks(spark, sf).select("doc_id", "ordinal").collect():
        have[r.doc_id].add(r.ordinal)
    assert all(len(s) == len(set(s)) and have[d] <= set(s) for d, s in seen.items()) and seen.keys() == have.keys()


def test_dataset_fingerprint_and_sample(spark, sf):
    rows = chunks(spark, sf)
    first = A.dataset_fingerprint(rows).first()
    assert first == A.dataset_fingerprint(rows.repartition(7).select(*reversed(rows.columns))).first() and first.n == rows.count()
    other = rows.withColumn("text", F.when(F.col("chunk_id") == 0, "x").otherwise(F.col("text")))
    assert A.dataset_fingerprint(other).first().fingerprint != first.fingerprint
    assert A.dataset_fingerprint(rows.unionByName(rows.limit(1))).first().fingerprint != first.fingerprint
    once = [r.doc_id for r in registry.QUERIES["seeded_sample"](spark, sf).collect()]
    again = [r.doc_id for r in registry.QUERIES["seeded_sample"](spark, sf).collect()]
    assert once == again and len(set(once)) == 100


@pytest.mark.parametrize("query, most, overlap", [("chunk_recursive", C.MAX_CHARS, C.OVERLAP), ("merge_overlap", 400, 50)])
def test_pieces_of_all_documents(spark, sf, query, most, overlap):
    """Dense ordinals, no piece too long, and every letter of the text once, apart from the overlap."""
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    found = defaultdict(dict)
    for r in registry.QUERIES[query](spark, sf).collect():
        found[r.doc_id][r.ordinal] = r.text
        # the space after a lead is not counted
        assert len(r.text) <= most + (overlap > 0) and r.text == r.text.strip() and r.text
    bare = lambda t: re.sub(r"[\s.,;!?]+", "", t)
    for d, pieces in found.items():
        assert sorted(pieces) == list(range(len(pieces)))
        assert all(bare(p) in bare(text[d]) or overlap for p in pieces.values())
        plain = C.recursive_pieces(text[d], most, 0)
        assert bare("".join(plain)) == bare(text[d]) and len(plain) == len(pieces)
        assert all(pieces[k].endswith(p) for k, p in enumerate(plain))


def test_piece_literals():
    assert C.recursive_pieces("paragraph one.\n\nparagraph two.\n\nparagraph three.", 20, 0) == ["paragraph one.", "paragraph two.", "paragraph three."]
    assert C.recursive_pieces("A. B. C. D. E. F.", 12, 0) == ["A. B. C. D", "E. F."]
    assert C.recursive_pieces("a" * 100, 30, 0) == ["a" * 30, "a" * 30, "a" * 30, "a" * 10]
    assert C.recursive_pieces("AAAAA. BBBBB. CCCCC. DDDDD. EEEEE.", 18, 4) == ["AAAAA. BBBBB", "BBBB CCCCC. DDDDD", "DDDD EEEEE."]
