import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from corvane.llm import periodic, registry
from corvane.llm.periodic import find_runs, occurrences, op13_periodic_runs, periodic_runs, with_planted_periods


def brute(words, least=24, times=3):
    """(start, end, period) by comparing the words with themselves at every distance."""
    x, out = np.array(words), []
    for q in range(1, len(x) // times + 1):
        same = np.concatenate(([False], x[:-q] == x[q:], [False]))
        for s, t in np.flatnonzero(np.diff(same.astype(int))).reshape(-1, 2).tolist():
            e = t + q
            if e - s >= max(least, times * q) and not any(q % p == 0 and a <= s and b >= e for a, b, p in out):
                out.append((s, e, q))
    return sorted(out)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def arrays():
    rng = np.random.default_rng(4)
    yield from (np.zeros(n, int) for n in (1, 7, 23, 24, 25, 300))
    yield np.array(fibonacci(1200))
    yield np.array([bin(i).count("1") % 2 for i in range(4096)])
    yield np.concatenate((np.zeros(200), [1], np.zeros(300), [1], np.zeros(299)))
    yield np.tile(np.repeat([0, 1], 20), 21)
    for _ in range(150):
        parts = []
        for _ in range(rng.integers(1, 6)):
            word = rng.integers(0, rng.integers(1, 50) + 1, rng.integers(1, 70))
            parts.append(np.tile(word, rng.integers(1, 8))[rng.integers(0, 5) :])
        yield np.concatenate(parts)


def test_runs_by_brute_force():
    for x in arrays():
        assert sorted(map(tuple, find_runs(x.astype(np.uint64), len(x)).tolist())) == brute(x)


def test_other_limits():
    for x in arrays():
        assert sorted(map(tuple, find_runs(x.astype(np.uint64), len(x), 40, 4).tolist())) == brute(x, 40, 4)
    with pytest.raises(ValueError):
        find_runs(np.zeros(9, np.uint64), 9, 10, 2)


@pytest.mark.parametrize("size", [8, 32, 128])
def test_transform_gives_all_occurrences(size):
    rng = np.random.default_rng(size)
    x = np.tile(rng.integers(0, 1 << 30, size + size // 2), 5).astype(np.uint64)
    starts = np.arange(0, len(x) - size + 1, size)
    u, d = occurrences(x, starts, size, size)
    want = {(s, k) for s in starts.tolist() for k in range(size, 2 * size) if s + k + size <= len(x) and (x[s : s + size] == x[s + k : s + k + size]).all()}
    assert set(zip(u.tolist(), d.tolist(), strict=True)) == want and want


def test_false_seeds_and_clashing_hashes_are_no_runs(monkeypatch):
    """Seeds that are none and hashes that are all equal change nothing."""
    real = periodic.occurrences

    def more(x, starts, size, first):
        u, d = real(x, starts, size, first)
        extra = starts[starts + first + size <= len(x)]
        return np.concatenate((u, extra)), np.concatenate((d, np.full(len(extra), first)))

    monkeypatch.setattr(periodic, "occurrences", more)
    monkeypatch.setattr(periodic.Stretches, "equal", lambda self, a, b, size: np.array([(self.x[i : i + k] == self.x[j : j + k]).all() or (i + j + k) % 5 == 0 for i, j, k in zip(a, b, size, strict=True)]))
    monkeypatch.setattr(periodic.Stretches, "__init__", lambda self, x: self.__dict__.update(x=x, n=len(x)))
    for x in list(arrays())[8:60]:
        assert sorted(map(tuple, find_runs(x.astype(np.uint64), len(x)).tolist())) == brute(x)


def digest(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    n = len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute([hash(w) for w in words]) if words else []
    best = max(runs, key=lambda r: (Fraction(r[1] - r[0], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in sorted(runs, key=lambda r: (r[0], r[2])))), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_by_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " \n\t "[rng.randrange(4)].join(rng.choice(["für", "a", "b", "世界 ", "\x0bx y"]) for _ in range(rng.randrange(0, 400))), 1) for i in range(300)]
    rows += [(1000, None, 1), (1001, "", 1), (1002, "  \n ", 1), (1003, "la " * 5000, 1), (1004, "la " * 23, 1), (1005, "la " * 24, 1), (1003, "la " * 5000, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, runs int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((digest([w for w in bytes(t or "", "utf-8").decode().translate(dict.fromkeys((9, 10, 11, 12, 13), " ")).split(" ") if w], i) for i, t, _ in rows), key=str)


def test_very_long_text(spark):
    rng = random.Random(1)
    unit = [f"w{rng.randrange(10**6)}" for _ in range(30_000)]
    text = " ".join(["start", *unit * 4, "end"])
    (row,) = periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row.runs] == [(1, 120_000, 30_000)] and row.collapsed == " ".join(["start", *unit, "end"])


def test_edge_cases(spark):
    df = spark.createDataFrame([(None, "x " * 30, 1, "q"), (5, None, 2, "q")], "doc_id long, text string, n_words int, collapsed string")
    out = {r.doc_id: r for r in periodic_runs(df).collect()}
    assert [tuple(r) for r in out[None].runs] == [(0, 30, 1)] and out[None].collapsed == "x" and out[5].runs == [] and out[5].collapsed == ""
    assert periodic_runs(df.limit(0)).count() == 0
    assert with_planted_periods(df).filter("doc_id IS NULL").first().text == "x " * 30


def test_twin(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(registry.ORACLE_SQL["op13_periodic_runs"]).fetchall(), key=str)
    got = sorted(map(tuple, op13_periodic_runs(spark, sf).collect()), key=str)
    assert got == want and sum(r[1] > 0 for r in got) > 10
