"""Importance resampling towards a target text by hashed word n-grams (operator 12).

Two bags of bucket counts, one of the corpus and one of the target, give each bucket a gain: the
logarithm of its smoothed share in the target over that in the corpus, in thousandths.  A document
weighs the sum of its features' gains; weight plus a Gumbel variate drawn from a hash of its id is
its score, and the highest scores are a sample without replacement by weight.

Counting is one map pass.  A task joins the texts of a batch with a sentinel that no UTF-8 text can
contain between them, one regular expression finds the words and sentinels of all texts, the places
of the sentinels are the documents' offsets, and ``searchsorted`` on them says which document each
feature starts and ends in, so features across documents are masked before ``bincount``.  A task
returns at most one row a bucket, so the shuffle doesn't grow with the texts; the gains, one number a
bucket, go to the second pass, which returns one row a document.  Ranks come from a range-partitioned
sort of (score, id) and the row counts of its partitions: no task sees more than its range, and equal
scores are told apart by id, so they are no hot key.

Memory: a batch is read in stretches of about STRETCH bytes, cut between words, with the last
``n`` - 1 words carried over, so a very long text needs no more than many short ones.

Defined results: a null or empty text has no features, weight 0 and no rank unless ``least_words`` is
0; a null id hashes as ``null`` and comes last among equal scores; repeated rows are documents of
their own, ordered by weight and features when ids are equal; an empty corpus gives no rows, an empty
target gains from smoothing alone; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .io import table, written
from .twins import crc32_sql

#: Words of lower-cased UTF-8: ASCII digits and letters, and all that is not ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
#: A byte that UTF-8 never uses: a word of its own between two texts.
SENTINEL = b"\xff"
STRETCH = 1 << 20


def _stretches(joined: bytes) -> Iterator[list[bytes]]:
    """Words and sentinels of ``joined``, in lists of about STRETCH bytes."""
    at = 0
    while at < len(joined):
        gap = GAP.search(joined, at + STRETCH)
        end = gap.end() if gap else len(joined)
        yield WORD.findall(joined, at, end)
        at = end


def batch_features(texts: pa.Array, most: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, buckets, words of each row) of the 1- to ``most``-grams of a batch, in parts."""
    for at, n, data, offsets in K.string_chunks(texts):
        raw = data.tobytes()
        joined = (b" " + SENTINEL + b" ").join(raw[a:b] for a, b in zip(offsets, offsets[1:], strict=False)).lower()
        row, carry = 0, []
        for found in _stretches(joined):
            words = carry + found
            ends = np.flatnonzero(np.fromiter((w == SENTINEL for w in words), bool, len(words)))
            new = len(carry)
            row -= int(np.searchsorted(ends, new))  # the carried words were counted from their own row on
            rows, codes = [], []
            for size in range(1, most + 1):
                grams = words if size == 1 else [b" ".join(g) for g in zip(*(words[j:] for j in range(size)), strict=False)]
                code = {g: zlib.crc32(g) % buckets for g in set(grams)}
                start = np.arange(len(grams))
                first, last = np.searchsorted(ends, start), np.searchsorted(ends, start + size - 1, "right")
                inside = (first == last) & (start + size > new)
                rows.append(row + first[inside])
                codes.append(np.fromiter(map(code.__getitem__, grams), np.int64, len(grams))[inside])
            fresh = np.arange(new, len(words))
            real = fresh[~np.isin(fresh, ends)]
            yield at, np.concatenate(rows), np.concatenate(codes), np.bincount(row + np.searchsorted(ends, real), minlength=n)
            row += len(ends)
            carry = words[len(words) - most + 1 :] if most > 1 else []


def bucket_counts(df: DataFrame, text: str = "text", most: int = 1, buckets: int = 10000) -> DataFrame:
    """(bucket, n): features of all texts; at most ``buckets`` rows, and as many leave each task."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, codes, _ in batch_features(batch.column(0), most, buckets):
                total += np.bincount(codes, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return df.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed bucket shares, floored."""
    s, t = corpus.astype(float), target.astype(float)
    m = float(len(s))
    return np.floor(1000.0 * np.log((t + 1.0) * (s.sum() + m) / ((s + 1.0) * (t.sum() + m)))).astype(np.int64)


def _dense(counts: DataFrame, buckets: int) -> np.ndarray:
    found = counts.toArrow()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def weigh(df: DataFrame, gain: np.ndarray, id: str = "doc_id", text: str = "text", most: int = 1) -> DataFrame:
    """(id, n_words, n_features, weight) of every row."""
    kind = df.schema[id].dataType.simpleString()

    def score(batches):
        for batch in batches:
            n = batch.num_rows
            words, features, weight = (np.zeros(n, np.int64) for _ in range(3))
            for at, rows, codes, counted in batch_features(batch.column(1), most, len(gain)):
                size = len(counted)
                words[at : at + size] += counted
                features[at : at + size] += np.bincount(rows, minlength=size)
                np.add.at(weight, at + rows, gain[codes])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    return df.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(score, f"id {kind}, n_words long, n_features long, weight long")


def ranked(df: DataFrame, order: list) -> DataFrame:
    """Adds ``rank``, 1, 2, 3 ... over all rows in ``order``, without a task that sees all rows.

    The rows are range-partitioned and sorted, each carrying its partition and its place in it; the
    partitions' row counts, one row each, are summed up before.
    """
    placed = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy("_part").agg(F.count("*").alias("n"))
    before = parts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    place = F.col("_at") - F.shiftleft(F.col("_part"), 33)
    return placed.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + place + 1).drop("_at", "_part", "_before")


def resample(corpus: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text", most: int = 1, buckets: int = 10000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """Every row of ``corpus`` as (id, n_words, n_features, weight, score, rank).

    ``rank`` numbers the drawn rows: the highest scores, ``percent`` of the rows with at least
    ``least_words`` words; it is null for all others.
    """
    gain = gains(_dense(bucket_counts(corpus, text, most, buckets), buckets), _dense(bucket_counts(target, target_text, most, buckets), buckets))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    u = (F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    scored = written(weigh(corpus, gain, id, text, most).withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(u)))))
    enough = scored.filter(F.col("n_words") >= least_words)
    drawn = enough.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("weight"), F.asc("n_features"), F.asc("n_words")]
    out = ranked(enough, order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return out.unionByName(rest).withColumnRenamed("id", id)


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents towards all benchmark texts: words, 10,000 buckets, a tenth of the documents drawn."""
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def _words(rel: str) -> str:
    return f"SELECT {{}} unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM {rel}"


OP12_SQL = f"""
WITH d AS MATERIALIZED (SELECT k, doc_id, w FROM ({_words("(SELECT *, row_number() OVER () AS k FROM documents)").format("k, doc_id,")})),
b AS MATERIALIZED ({_words("benchmark").format("")}),
{crc32_sql("codes", "SELECT w FROM d UNION SELECT w FROM b", "w")},
s AS (SELECT crc % 10000 AS bucket, count(*) AS s FROM d JOIN codes USING (w) GROUP BY 1),
t AS (SELECT crc % 10000 AS bucket, count(*) AS t FROM b JOIN codes USING (w) GROUP BY 1),
g AS (SELECT i AS bucket, floor(1000.0::DOUBLE * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)::DOUBLE)))::BIGINT AS gain
      FROM range(10000) r(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i),
f AS (SELECT k, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM d JOIN codes USING (w) JOIN g ON g.bucket = crc % 10000 GROUP BY 1),
x AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        (coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score
      FROM (SELECT doc_id, row_number() OVER () AS k FROM documents) LEFT JOIN f USING (k)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS n FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND n <= (SELECT count(*) FROM x WHERE n_features >= 20) * 10 // 100 THEN n END AS rank FROM r
"""
