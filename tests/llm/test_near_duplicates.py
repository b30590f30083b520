import random

import numpy as np

from corvane.llm.graph import connected_components, merge_components
from corvane.llm.near_duplicates import estimate, near_duplicates, registers


def shingles(text, width):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows]
    part = {i: i for i, _ in rows}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                part[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets}


def noisy(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"n{rng.randrange(10**6)}"
    return " ".join(out)


def test_groups_of_copies_match_brute_force(spark):
    rng = random.Random(2)
    rows, n = [], 0
    for _ in range(4):
        base = [f"w{rng.randrange(400)}" for _ in range(120)]
        for _ in range(40):
            rows.append((n, noisy(rng, base, rng.randrange(12))))
            n += 1
    rows += [(n + i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 6)))) for i in range(40)]
    rows += [(n + 50, "One"), (n + 51, "one"), (n + 52, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width in (2,):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, width=width).collect()}
        assert got == brute(rows, width, 80)


def test_edge_cases(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, None), (2, ""), (3, "  \n"), (4, "A b c"), (4, "a b c"), (5, "x" * 300000)], "doc_id long, text string")
    out = near_duplicates(df.selectExpr("*", "1 AS kept", "2 AS id"), width=2).collect()
    assert len(out) == 7
    by = {r.doc_id: r for r in out}
    assert by[4].component_id is None and by[None].kept and by[1].component_id == 1 and by[5].n_shingles == 1
    assert near_duplicates(df.limit(0), width=2).count() == 0


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(0)
    n = 400
    for j in (0.5, 0.8):
        common = int(2 * n * j / (1 + j))
        pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        a, b = np.sort(pool[:n]), np.sort(np.concatenate((pool[:common], pool[n : 2 * n - common])))
        x, y = (registers(s, np.zeros(len(s), np.int64), 1)[0] for s in (a, b))
        assert abs(estimate(np.array([(x == y).sum()]), np.array([n]), np.array([n]))[0] - j) < 0.15


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (7, 7), (20, 11)] + [(100, 100 + i) for i in range(1, 300)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got[4] == 1 and got[20] == 10 and got[399] == 100 and 7 not in got
    more = merge_components(connected_components(df), spark.createDataFrame([(4, 20), (399, 500)], "a long, b long"))
    got = {r.node: r.component for r in more.collect()}
    assert got[11] == 1 and got[500] == 100
    assert connected_components(df.limit(0)).count() == 0


def test_links_of_very_small_sets_are_exact(spark):
    """Texts of few words, where one shingle more or less decides, against all pairs."""
    rng = random.Random(12)
    rows, n = [], 0
    for _ in range(700):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(2, 14))]
        rows.append((n, " ".join(words)))
        rows.append((n + 1, " ".join(words + [f"x{n}"])))
        n += 2
    sets = [{" ".join(w[i : i + 2]) for i in range(len(w) - 1)} for w in (t.split() for _, t in rows)]
    out = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2, percent=80).collect()}
    for i in range(0, n, 2):
        a, b = sets[i], sets[i + 1]
        assert (out[i + 1] == i) == (100 * len(a & b) >= 80 * len(a | b)) and out[i] == i


def test_pairs_that_connect_are_no_more_than_the_rows():
    import pyarrow as pa

    from corvane.llm.pairing import _across

    rng, n = random.Random(7), 120
    rows = [(key, node, node // 3 if node < 30 else node) for key in range(4) for node in range(n) if rng.random() < 0.8]
    table = pa.table({"key": [r[0] for r in rows] * 2, "node": [r[1] for r in rows] * 2, "comp": [r[2] for r in rows] * 2, "i": [0] * (2 * len(rows)), "j": [0] * (2 * len(rows)), "odd": [True] * (2 * len(rows)), "probe": [False] * len(rows) + [True] * len(rows)})

    def judge(columns, f, members):
        node = columns["node"]
        return members[(node[members] + node[f]) % 5 < 3], None

    def parts(pairs):
        part = {node: comp for _, node, comp in rows}
        for a, b in pairs:
            x, y = part[a], part[b]
            part = {k: (x if v == y else v) for k, v in part.items()}
        groups = {}
        for k, v in part.items():
            groups.setdefault(v, set()).add(k)
        return sorted(map(sorted, groups.values()))

    every, few = (list(zip(*_across(("node",), judge, connect)(table).to_pydict().values(), strict=True)) for connect in (False, True))
    assert parts(few) == parts(every) and len(few) < n < len(every) / 10
