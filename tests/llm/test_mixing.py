import random
from collections import defaultdict

import duckdb
import pytest

from corvane.llm import registry
from corvane.llm.mixing import mix_sources, op10_mixing
from corvane.llm.near_duplicates import op6_minhash_near_dedup

TABLES = "documents labels pages benchmark".split()


def filled(sizes, weights, total):
    """Targets by resharing what exceeds the caps."""
    target, open_, rest = {}, dict(weights), total
    while open_:
        w = sum(open_.values())
        over = {s for s in open_ if rest * open_[s] / w > 2 * sizes[s]}
        if not over:
            return target | {s: rest * open_[s] / w for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
            del open_[s]
    return target


def test_targets_and_shares(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice(["a", "b", "c", "d", None])) for i in range(900)] + [(1000 + i, "v " * 50, "a") for i in range(500)]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = defaultdict(int)
    for r in out:
        sizes[r.source] += r.size
    order = sorted(s for s in sizes if s is not None) + [None]
    want = filled(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    taken = defaultdict(int)
    for r in out:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 60 for s in order)
    again = {r.doc_id: r.taken for r in mix_sources(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string")).collect()}
    assert again == {r.doc_id: r.taken for r in out}


def test_better_documents_are_drawn_more(spark):
    rows = [(i, "w " * 20 + ("### " * 20 if i % 2 else "x " * 20), f"s{i % 6}") for i in range(3000)]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).filter("source IN ('s2', 's5')")
    assert out.filter("drawn").count() > 0
    mixed = mix_sources(spark.createDataFrame([(i, t, "one") for i, t, _ in rows], "doc_id long, text string, source string")).collect()
    drawn = [r.doc_id % 2 for r in mixed if r.drawn]
    assert sum(drawn) < 0.4 * len(drawn)


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "a", 1), (2, "", None, 1), (None, "a b", "b", 1), (3, "c d", "b", 1), (3, "c d", "b", 1)], "doc_id long, text string, source string, size int")
    out = mix_sources(df).collect()
    assert len(out) == 5 and all(r.taken <= 2 * r.size for r in out)
    assert {r.target for r in out if r.source == "b"} == {9.0} and sum(r.taken for r in out) in (8, 10)
    assert mix_sources(df.limit(0)).count() == 0


@pytest.mark.parametrize("name, query", [("op10_mixing", op10_mixing), ("op6_minhash_near_dedup", op6_minhash_near_dedup)])
def test_twins(spark, sf, name, query):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(map(tuple, cursor.fetchall()))
    assert sorted(tuple(r) for r in query(spark, sf).select(*columns).collect()) == want
