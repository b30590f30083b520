import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from corvane.llm import importance, registry
from corvane.llm.importance import batch_features, op12_target_resampling, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, most):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, most, buckets, least, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    cut = [(i, *features(t, most)) for i, t in docs]
    s = Counter(bucket(f) for _, _, fs in cut for f in fs)
    t = Counter(bucket(f) for text in target for f in features(text, most)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (ns + float(buckets)) / ((s[b] + 1.0) * (nt + float(buckets)))))
    rows = []
    for i, n, fs in cut:
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2], r[1]))
    drawn = len(enough) * percent // 100
    out = [(*r, k + 1 if k < drawn else None) for k, r in enumerate(enough)] + [(*r, None) for r in rows if r[1] < least]
    return sorted(out, key=str)


def texts(rng, n):
    words = ["alpha", "Beta", "gamma7", "Öl", "straße", "世界", "x", "ÄRGER", "d"]
    seps = [" ", "\n", "-", "\x00", ", ", "'"]
    return ["".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("most, stretch", [(1, 1 << 20), (3, 1 << 20), (2, 16), (3, 1)])
def test_brute_force(spark, monkeypatch, most, stretch):
    rng = random.Random(most * 7 + stretch % 5)
    docs = list(enumerate(texts(rng, 120))) + [(500, None), (501, ""), (None, "alpha beta " * 20), (7, "alpha " * 30), (7, "alpha " * 30)]
    target = [*texts(rng, 15), None]
    # what a task does with a batch, cut into stretches of any length
    monkeypatch.setattr(importance, "STRETCH", stretch)
    got = Counter()
    for at, rows, codes, _ in batch_features(pa.array([t for _, t in docs]), most, 97):
        got.update(zip((at + rows).tolist(), codes.tolist(), strict=True))
    assert got == Counter((k, zlib.crc32(f.encode()) % 97) for k, (_, t) in enumerate(docs) for f in features(t, most)[1])
    out = resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), most=most, buckets=97, least_words=10, percent=30)
    assert sorted(map(tuple, out.collect()), key=str) == brute(docs, target, most, 97, 10, 30)


def test_very_long_text_crosses_stretches(spark):
    docs = [(1, "alpha beta " * 150_000), (2, "gamma " * 25)]
    out = resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("alpha",)], "text string"), percent=50)
    assert sorted(map(tuple, out.collect()), key=str) == brute(docs, ["alpha"], 1, 10000, 20, 50)


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, "a b c", 3, 4.0), (2, None, 1, 0.5)], "doc_id long, text string, rank int, weight double")
    target = spark.createDataFrame([], "text string")
    out = {r.doc_id: r for r in resample(df, target, least_words=1, percent=100).collect()}
    assert out[1].rank == 1 and out[1].n_features == 3 and out[2].rank is None and out[2].weight == 0
    assert resample(df.limit(0), target).count() == 0
    # equal scores follow the id, whatever the order of the rows
    same = spark.createDataFrame([(9, "a " * 20), (9, "a " * 20), (9, "a " * 20)], "doc_id long, text string")
    assert sorted(r.rank for r in resample(same, target, percent=100).collect()) == [1, 2, 3]


def test_towards_the_target(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["law", "court", "judge"] if i % 4 == 0 else ["milk", "bread", "salt"]) for _ in range(40))) for i in range(400)]
    target = spark.createDataFrame([("court judge law " * 30,)], "text string")
    drawn = [r.doc_id for r in resample(spark.createDataFrame(rows, "doc_id long, text string"), target).collect() if r.rank]
    assert len(drawn) == 40 and all(i % 4 == 0 for i in drawn)


def test_twin(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = sorted(con.execute(registry.ORACLE_SQL["op12_target_resampling"]).fetchall(), key=str)
    assert sorted(map(tuple, op12_target_resampling(spark, sf).collect()), key=str) == want
