import random
import re

from corvane.llm.io import table
from corvane.llm.substrings import op3_substring_dedup, remove_repeated_windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            if k in seen:
                gone[s : s + width] = [True] * width
            seen.add(k)
        out[i] = (" ".join(x for x, g in zip(w, gone, strict=True) if not g), len(w), sum(gone))
    return out


def got(df):
    return {r.doc_id: (r.kept_text, r.n_words, sum(x.end - x.start for x in r.removed)) for r in df.collect()}


def test_random_texts_match_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(40)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(remove_repeated_windows(df, width=5)) == brute(rows, 5)


def test_all_documents_match_brute_force(spark, sf):
    import hashlib

    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    want = {i: (n, g, hashlib.sha256(t.encode()).hexdigest()) for i, (t, n, g) in brute(rows, 20).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op3_substring_dedup(spark, sf).collect()} == want


def test_edge_cases(spark):
    rows = [(None, "a b " * 30), (1, None), (2, ""), (3, "x " * 50), (4, "x " * 50), (4, "x " * 50), (5, "é" * 200000)]
    df = spark.createDataFrame([(*r, "k", 0) for r in rows], "doc_id long, text string, kept_text string, id int")
    out = remove_repeated_windows(df).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 7 and by[None].kept_text == "a b" and by[1].n_words == 0 and by[3].kept_text == "x" and by[4].kept_text == "" and by[5].n_words == 1
    assert [tuple(x) for x in by[3].removed] == [(1, 50)]
    assert remove_repeated_windows(df.limit(0)).count() == 0
