"""Periodic runs of words by block convolution (operator 13).

A run is a stretch of words of smallest period q, of at least ``least`` words and ``times`` * q
words, that cannot be made longer on either side.  A batch of documents is one array of word numbers
with a number of its own after each document, so no run crosses documents.

For periods in [B, 2B), B a power of two, the array is cut into blocks of B words.  A run compares
equal with itself q places on over at least 2q words, so it holds a whole block that stands again at
distance q.  The sums of squared differences of a block with the places of the window after it come
from one cyclic convolution, by a number-theoretic transform modulo a prime: exact integers, no
rounding.  Distances where the sum is zero are seeds; neighbouring blocks with one distance are one
seed, and a seed is extended on both sides by binary search over prefix hashes.  Long enough
stretches are compared word by word before they count, so neither a sum that only vanishes modulo
the prime nor a clash of hashes is ever a run, and none is lost, as equal words give zero and equal
hashes always.

Two exact shortcuts.  A block is convolved only if each of its words stands again within the reach of
the scale (O(n) for all scales), which few blocks of ordinary text pass.  And a block whose whole
window lies in a run of a smaller scale is left out: all its distances are multiples of that run's
period.  For the same reason seeds inside such a run are dropped, so what is left has no smaller
period.  The worst case is O(n log^2 n) for a document of n words, on one word repeated or on any other text.

Documents are independent: the job is one map pass without a shuffle.

Defined results: a null or empty text has no words and no runs; rows are worked on by themselves, so
repeated ids and rows have a row each; a null id is kept; very long texts are a batch of their own
(periods up to 2^26 words); runs are ordered by start, then period; further columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .io import table
from .twins import crc32_sql

#: A prime 15 * 2^27 + 1 and a generator of its multiplicative group.
PRIME, GENERATOR = 2013265921, 31
P = np.uint64(PRIME)
#: Words of the smallest block, and numbers that one transform takes at a time.
SMALLEST, TOGETHER = 8, 1 << 19
FAR = np.int64(1 << 62)
WORD = r"[^\x20\x09-\x0D]+"


@lru_cache(maxsize=64)
def _roots(half: int, inverse: bool) -> np.ndarray:
    """The first ``half`` powers of a root of unity of order 2 * half."""
    root = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
    root = pow(root, -1, PRIME) if inverse else root
    out, n = np.ones(1, np.uint64), 1
    while n < half:
        out = np.concatenate((out, out * np.uint64(pow(root, n, PRIME)) % P))
        n *= 2
    return out


def _transform(a: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each row, in place, values in bit-reversed order."""
    m, n = a.shape
    half = n // 2
    while half:
        v = a.reshape(m, n // (2 * half), 2, half)
        x, y = v[:, :, 0], v[:, :, 1]
        low = (x + y) % P
        v[:, :, 1] = (x + (P - y)) * _roots(half, False) % P
        v[:, :, 0] = low
        half //= 2
    return a


def _back(a: np.ndarray) -> np.ndarray:
    """Inverse of _transform(), from bit-reversed to natural order."""
    m, n = a.shape
    half = 1
    while half < n:
        v = a.reshape(m, n // (2 * half), 2, half)
        y = v[:, :, 1] * _roots(half, True) % P
        x = v[:, :, 0].copy()
        v[:, :, 0] = (x + y) % P
        v[:, :, 1] = (x + (P - y)) % P
        half *= 2
    return a * np.uint64(pow(n, -1, PRIME)) % P


def occurrences(x: np.ndarray, starts: np.ndarray, size: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(block starts, distances): where the blocks of ``size`` words stand again at ``first`` to ``first`` + ``size`` - 1.

    Zeros of the sum of squared differences modulo PRIME: all real ones, and rarely one that is none.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    n = len(x)
    group = max(1, TOGETHER // (2 * size))
    for g in range(0, len(starts), group):
        at = starts[g : g + group]
        block = x[at[:, None] + np.arange(size)]
        place = at[:, None] + first + np.arange(2 * size - 1)
        window = np.where(place < n, x[np.minimum(place, n - 1)], np.uint64(PRIME - 1))
        a = np.zeros((len(at), 2 * size), np.uint64)
        b = np.zeros((len(at), 2 * size), np.uint64)
        a[:, :size] = block[:, ::-1]
        b[:, : 2 * size - 1] = window
        both = _back(_transform(a) * _transform(b) % P)[:, size - 1 : 2 * size - 1]
        squares = np.zeros((len(at), 2 * size), np.uint64)
        np.cumsum(window * window % P, axis=1, out=squares[:, 1:])
        own = (block * block % P).sum(axis=1, keepdims=True)
        apart = (own + squares[:, size : 2 * size] - squares[:, :size]) % P
        row, d = np.nonzero(apart == both * np.uint64(2) % P)
        inside = at[row] + first + d + size <= n
        found.append((at[row][inside], d[inside] + first))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class Stretches:
    """Equality of stretches of one array by prefix hashes."""

    def __init__(self, x: np.ndarray):
        self.n = len(x)
        up, self.down = K.powers(K.BASE_B).upto(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(K.mix(x, 5) * up[: self.n], out=self.sums[1:])

    def equal(self, a, b, size):
        with np.errstate(over="ignore"):
            return (self.sums[a + size] - self.sums[a]) * self.down[a] == (self.sums[b + size] - self.sums[b]) * self.down[b]

    def extent(self, a: np.ndarray, d: np.ndarray, left: bool) -> np.ndarray:
        """How many words before (or from) ``a`` equal those ``d`` places on."""
        low, high = np.zeros(len(a), np.int64), (a if left else self.n - a - d).astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(a - mid, a - mid + d, mid) if left else self.equal(a, a + d, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


class Known:
    """Asks whether stretches lie inside one of the runs given."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray):
        order = np.argsort(starts, kind="stable")
        self.starts = starts[order]
        self.reach = np.maximum.accumulate(np.append(np.int64(-1), ends[order]))

    def holds(self, a, b):
        return self.reach[np.searchsorted(self.starts, a, "right")] >= b


def _settle(x: np.ndarray, s: int, e: int, d: int, u: int) -> tuple[int, int]:
    """Start and end of the stretch of period ``d`` around ``u``, word by word if the one given isn't it."""
    if (x[s : e - d] == x[s + d : e]).all() and (s == 0 or x[s - 1] != x[s + d - 1]) and (e == len(x) or x[e] != x[e - d]):
        return s, e
    differ = np.flatnonzero(x[:-d] != x[d:])
    k = int(np.searchsorted(differ, u))
    if k < len(differ) and differ[k] == u:
        return u, u
    return (int(differ[k - 1]) + 1 if k else 0), (int(differ[k]) + d if k < len(differ) else len(x))


def find_runs(x: np.ndarray, longest: int, least: int = 24, times: int = 3) -> np.ndarray:
    """Rows (start, end, period) of all runs of ``x`` (uint64 below PRIME) with a period of at most ``longest`` / ``times``.

    ``times`` is at least 3 and ``least`` at least 3 * SMALLEST, as the blocks need.
    """
    if times < 3 or least < 3 * SMALLEST:
        raise ValueError(f"runs of fewer than 3 periods or {3 * SMALLEST} words may hold no whole block")
    n = len(x)
    order = np.argsort(x, kind="stable")
    again = np.full(n, FAR)
    same = x[order[1:]] == x[order[:-1]]
    again[order[:-1][same]] = np.diff(order)[same]
    runs = np.zeros((0, 3), np.int64)
    stretches = None
    size, reach = SMALLEST, again[: n - n % SMALLEST].reshape(-1, SMALLEST).max(axis=1) if n >= SMALLEST else np.zeros(0, np.int64)
    while size == SMALLEST or times * size <= longest:
        for first in (1, size) if size == SMALLEST else (size,):
            starts = np.flatnonzero(reach < first + size) * size
            smaller = runs[runs[:, 2] < first]
            known = Known(smaller[:, 0], smaller[:, 1])
            starts = starts[~known.holds(starts, starts + first + 2 * size - 1)]
            u, d = occurrences(x, starts, size, first)
            keep = (times * d <= longest) & ~known.holds(u, u + size + d)
            u, d = u[keep], d[keep]
            if not len(u):
                continue
            order = np.lexsort((u, d))
            u, d = u[order], d[order]
            head = np.ones(len(u), bool)
            head[1:] = (d[1:] != d[:-1]) | (u[1:] != u[:-1] + size)
            u, d = u[head], d[head]
            stretches = stretches or Stretches(x)
            onward = stretches.extent(u, d, False)
            u, d, onward = (c[onward >= size] for c in (u, d, onward))
            s = u - stretches.extent(u, d, True)
            e = u + d + onward
            found = np.stack((s, e, d, u), axis=1)[e - s >= np.maximum(least, times * d)]
            _, one = np.unique(found[:, :3], axis=0, return_index=True)
            settled = [(*_settle(x, *row), *row[2:]) for row in found[one].tolist()]
            settled = [(s, e, d) for s, e, d, u in settled if e - s >= max(least, times * d) and s <= u and u + size + d <= e]
            runs = np.unique(np.concatenate((runs, np.array(settled, np.int64).reshape(-1, 3))), axis=0)
            if first < size:  # periods 1 to 8 are found together: what has a smaller one goes
                multiple = np.zeros(len(runs), bool)
                for q in range(1, size // 2 + 1):
                    of = runs[runs[:, 2] == q]
                    multiple |= (runs[:, 2] > q) & (runs[:, 2] % q == 0) & Known(of[:, 0], of[:, 1]).holds(runs[:, 0], runs[:, 1])
                runs = runs[~multiple]
        size *= 2
        pairs = len(reach) // 2
        reach = reach[: 2 * pairs].reshape(pairs, 2).max(axis=1)
    return runs


_FOUND = pa.schema(
    [("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.large_string())]
)


def _runs_of(data: np.ndarray, offsets: np.ndarray, least: int, times: int) -> pa.RecordBatch:
    n = len(offsets) - 1
    starts, ends, rows = K.words(data, offsets)
    counts = np.bincount(rows, minlength=n)
    at = np.concatenate(([0], np.cumsum(counts + 1)))  # where each document starts among words and marks
    spot = np.arange(len(rows)) + rows
    numbers, distinct = K.word_numbers(data, starts, ends)
    x = np.empty(len(rows) + n, np.uint64)
    x[spot] = numbers
    x[at[1:] - 1] = distinct + np.arange(n)
    runs = find_runs(x, int(counts.max(initial=0)), least, times)
    row = np.searchsorted(at, runs[:, 0], "right") - 1
    order = np.lexsort((runs[:, 2], runs[:, 0]))
    runs, row = runs[order], row[order]

    gone = np.zeros(len(x) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(gone)[spot] == 0)
    # a kept word and one blank after it, but for the last kept word of a document
    last = np.ones(len(kept), bool)
    last[:-1] = rows[kept[1:]] != rows[kept[:-1]]
    change = np.zeros(len(data) + 2, np.int8)
    stop = ends[kept] + ~last
    np.add.at(change, starts[kept], 1)
    np.add.at(change, stop, -1)
    text = data.copy()
    text[ends[kept[~last]]] = 0x20
    text = text[np.cumsum(change[: len(data)], dtype=np.int8) > 0]
    lengths = np.bincount(rows[kept], weights=stop - starts[kept], minlength=n).astype(np.int64)
    collapsed = pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.concatenate(([0], np.cumsum(lengths)))), pa.py_buffer(text))
    struct = pa.StructArray.from_arrays([pa.array(runs[:, 0] - at[row]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), struct)
    return pa.RecordBatch.from_arrays([pa.array(counts), lists, collapsed], schema=_FOUND)


def periodic_runs(df: DataFrame, id: str = "doc_id", text: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """Per row: id, ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    ``collapsed`` are the words outside all runs or in the first period of every run that holds them,
    joined by one space.
    """

    def find(batches):
        for batch in batches:
            for at, n, data, offsets in K.string_chunks(batch.column(1)):
                found = _runs_of(data, offsets, least, times)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *found.columns], ["id", *_FOUND.names])

    kind = df.schema[id].dataType.simpleString()
    found = df.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(find, f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return found.withColumnRenamed("id", id)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; ties: the smallest start, then period."""
    better = lambda a, b: a.length * b.period > b.length * a.period
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, F.lit(0)), lambda best, r: F.when(better(r, best), r).otherwise(best))


def with_planted_periods(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """In one document of ten, by a hash of its id, the words repeat with one period from some word on.

    With h the unsigned crc32 of the id as text, g = h / 10 and n words, it starts at word g % n and has
    the period 1 + (n - start) / (3 + g % 8).  Other rows, and rows with a null id, stay as they are.
    """
    h = F.crc32(F.col(id).cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    n, g = F.size("_words").cast("long"), F.floor(F.col("_h") / 10)
    a = F.pmod(g, n)
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
    moved = F.transform("_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get(F.col("_words"), (F.col("_a") + F.pmod(i - F.col("_a"), F.col("_p"))).cast("int"))))
    chosen = df.withColumn("_h", h).withColumn("_words", F.when(F.pmod("_h", F.lit(10)) == 0, words))
    planted = chosen.withColumn("_a", F.when(n > 0, a)).withColumn("_p", F.when(n > 0, p))
    return planted.withColumn(text, F.when(F.col("_a").isNotNull(), F.array_join(moved, " ")).otherwise(F.col(text))).drop("_h", "_words", "_a", "_p")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, runs of at least 24 words and three periods, as digests."""
    docs = with_planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs(docs).withColumn("best", strongest(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit(""))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP13_SQL = rf"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, doc_id::VARCHAR AS name, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
{crc32_sql("codes", "SELECT name FROM docs", "name")},
placed AS (SELECT k, doc_id, w, crc, crc // 10 AS g, (crc // 10) % nullif(len(w), 0) AS a FROM docs JOIN codes USING (name)),
d AS MATERIALIZED (SELECT k, doc_id, CASE WHEN crc % 10 = 0 AND len(w) > 0 THEN list_transform(range(len(w)), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (len(w) - a) // (3 + g % 8)) + 1] END) ELSE w END AS w FROM placed),
e AS MATERIALIZED (SELECT k, len(w) AS n, unnest(range(len(w))) AS i, unnest(w) AS word FROM d),
grams AS MATERIALIZED (SELECT k, n, i, lead(i, 7) OVER p AS full_gram, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p || ' ' || lead(word, 3) OVER p || ' ' || lead(word, 4) OVER p || ' ' || lead(word, 5) OVER p || ' ' || lead(word, 6) OVER p || ' ' || lead(word, 7) OVER p AS gram FROM e WINDOW p AS (PARTITION BY k ORDER BY i)),
cand AS MATERIALIZED (SELECT DISTINCT x.k, y.i - x.i AS q FROM grams x JOIN grams y ON x.k = y.k AND x.gram = y.gram AND y.i > x.i AND (y.i - x.i) * 3 <= x.n WHERE x.i % 8 = 0 AND x.full_gram IS NOT NULL),
eq AS (SELECT c.k, c.q, x.i, x.i - row_number() OVER (PARTITION BY c.k, c.q ORDER BY x.i) AS island FROM cand c JOIN e x ON x.k = c.k JOIN e y ON y.k = c.k AND y.i = x.i + c.q AND y.word = x.word),
s AS MATERIALIZED (SELECT k, q, min(i) AS a, count(*) + q AS l FROM eq GROUP BY k, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS MATERIALIZED (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.k = s.k AND t.q < s.q AND s.q % t.q = 0 AND t.a <= s.a AND t.a + t.l >= s.a + s.l)),
digests AS (SELECT k, count(*) AS n_runs, string_agg(a || ',' || l || ',' || q || chr(10), '' ORDER BY a, q) AS listed FROM runs GROUP BY k),
best AS (SELECT r.* FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs t WHERE t.k = r.k AND (t.l * r.q > r.l * t.q OR (t.l * r.q = r.l * t.q AND (t.a < r.a OR (t.a = r.a AND t.q < r.q)))))),
kept AS (SELECT k, string_agg(word, ' ' ORDER BY i) AS collapsed FROM e WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.k = e.k AND e.i >= r.a + r.q AND e.i < r.a + r.l) GROUP BY k)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.a AS start, b.l AS length, b.q AS period, 1000 * b.l // b.q AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM d LEFT JOIN digests USING (k) LEFT JOIN best b USING (k) LEFT JOIN kept USING (k)
"""
