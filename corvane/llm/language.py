"""Language identification with averaged hashed subword embeddings (operator 8).

The byte 3-grams and 4-grams of the case-folded text, with everything but letters as one
boundary byte, are hashed to buckets; a document is the mean of its buckets' embeddings and a
linear softmax gives the languages.  Embeddings and softmax are trained together by stochastic
gradient descent in numpy on a bounded sample (``sample`` rows of each language, the first by a
hash of the id).  A held-back part of the sample fits the temperature of the probabilities and
the rejection threshold: the lowest probability above which at most ``error`` of the decided
rows are wrong.

After training embeddings and softmax fold into one small table, so scoring is a gather and a
sum per text, in one pass without a shuffle.

Defined results: a null text or one without a letter is ``und`` with score 0 and rejected; without
training rows every text is ``und``; texts of any length are scored whole; repeated rows
score alike; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .io import crc_mod, table, written

PARTS = 256
BUCKETS = 1 << 16
_SHAPE = np.full(256, 0x20, np.uint32)
_SHAPE[K.IS_LETTER] = np.arange(256)[K.IS_LETTER]
_SHAPE[65:91] = np.arange(97, 123)


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float
    threshold: float


def _ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and rows of all n-grams."""
    shape = _SHAPE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    buckets, rows = [], []
    for n, factor in ((3, np.uint32(0x9E3779B1)), (4, np.uint32(0x85EBCA77))):
        m = len(data) - n + 1
        if m <= 0:
            continue
        value, ok = np.zeros(m, np.uint32), row[:m] == row[n - 1 :]
        for j in range(n):
            value = (value << np.uint32(8)) | shape[j : j + m]
        ok &= (shape[1 : m + 1] != 0x20) | (shape[:m] != 0x20)
        at = np.flatnonzero(ok)
        with np.errstate(over="ignore"):
            h = value[at] * factor
        buckets.append((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1))
        rows.append(row[at])
    if not buckets:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(rows)


def _counted(batches):
    kind = pa.schema([("lang", pa.string()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        out = []
        for at, n, data, offsets in K.string_chunks(batch.column("text")):
            buckets, rows = _ngrams(data, offsets)
            values, counts = np.unique(rows * BUCKETS + buckets, return_counts=True)
            cuts = np.searchsorted(values, np.arange(n + 1) * BUCKETS)
            out += [{"lang": langs[at + i], "buckets": (values[cuts[i] : cuts[i + 1]] - i * BUCKETS).tolist(), "counts": counts[cuts[i] : cuts[i + 1]].tolist()} for i in range(n)]
        yield pa.RecordBatch.from_pylist(out, kind)


def train_softmax(rows: list, languages: list[str], dim: int = 16, epochs: int = 12, rate: float = 0.5, error: float = 0.005, seed: int = 0) -> LanguageModel:
    """SGD over (language index, buckets, counts); every fifth row is held back for calibration."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, dim))
    soft = np.zeros((dim, len(languages)))
    bias = np.zeros(len(languages))
    rows = [(y, b, c / c.sum()) for y, b, c in rows if len(b)]
    order = rng.permutation(len(rows))
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]
    step, steps = 0, max(1, epochs * len(fit))
    for _ in range(epochs):
        for i in rng.permutation(fit):
            y, b, w = rows[i]
            lr = rate * (1 - step / steps)
            step += 1
            mean = w @ embed[b]
            z = mean @ soft + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = soft @ p
            soft -= lr * np.outer(mean, p)
            bias -= lr * 0.1 * p
            embed[b] -= lr * len(b) ** 0.5 * np.outer(w, back)
    scores = embed @ soft
    model = LanguageModel(languages, scores.astype(np.float32), bias, 1.0, 0.0)
    if not len(held):
        return model
    z = np.array([rows[i][2] @ scores[rows[i][1]] + bias for i in held])
    y = np.array([rows[i][0] for i in held])

    def log_p(t):
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return s - np.log(np.exp(s).sum(axis=1, keepdims=True))

    model.temperature = float(min((0.05 * 1.15**k for k in range(45)), key=lambda t: -log_p(t)[np.arange(len(y)), y].mean()))
    best = np.exp(log_p(model.temperature))
    right, sure = best.argmax(axis=1) == y, best.max(axis=1)
    by = np.argsort(-sure, kind="stable")
    wrong = np.cumsum(~right[by]) / np.arange(1, len(y) + 1)
    fine = np.flatnonzero(wrong <= error)
    model.threshold = float(sure[by][fine[-1]]) if len(fine) and fine[-1] + 1 < len(y) else 0.0 if len(fine) else 1.0
    return model


#: Languages up to which a model is trained: its size is this times the buckets.
MOST_LANGUAGES = 200


def fit_language(rows: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 400, **how) -> LanguageModel:
    """Model from at most ``sample`` rows of each of at most MOST_LANGUAGES languages, repeated ids counted by row."""
    known = rows.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).withColumn("h", F.xxhash64("id", F.lit(8)))
    # first inside each of many parts of a language, then of what these leave: no task sees a whole language
    part = F.pmod(F.col("h"), F.lit(PARTS)).alias("part")
    inside, first = Window.partitionBy("lang", "part").orderBy("h", "id"), Window.partitionBy("lang").orderBy("h", "id")
    few = known.select("id", "lang", "h", part).withColumn("n", F.row_number().over(inside)).filter(F.col("n") <= sample)
    ids = written(few.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= sample).select("id").distinct())
    # an id may stand in any number of rows: as many rows as before are kept, not as many ids
    rows_of = Window.partitionBy("lang").orderBy("h", "id", F.xxhash64("text"))
    chosen = known.join(ids, "id", "left_semi").withColumn("n", F.row_number().over(rows_of)).filter(F.col("n") <= sample)
    if chosen.select("lang").distinct().count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: the model would not be of bounded size")
    found = chosen.select("lang", "text").repartition(8).mapInArrow(_counted, "lang string, buckets array<int>, counts array<int>").toPandas()
    languages = sorted(found["lang"].unique().tolist())
    data = [(languages.index(x), np.asarray(b, np.int64), np.asarray(c, float)) for x, b, c in zip(found["lang"], found["buckets"], found["counts"], strict=True)]
    data.sort(key=lambda r: (r[0], len(r[1]), r[1].tolist()[:8], r[2].sum()))  # the order of collected rows is not fixed
    return train_softmax(data, languages, **how) if languages else LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)


def identify_language(df: DataFrame, model: LanguageModel, text: str = "text", out: str = "language") -> DataFrame:
    """``df`` with ``out``: struct (lang, score, accepted)."""
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, kind)])
    arrow = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])
    columns = [np.ascontiguousarray(model.scores[:, j]) for j in range(len(model.languages))]

    def identify(batches):
        for batch in batches:
            results = []
            for _, n, data, offsets in K.string_chunks(batch.column(text)):
                buckets, rows = _ngrams(data, offsets)
                count = np.maximum(np.bincount(rows, minlength=n), 1)
                z = np.stack([np.bincount(rows, weights=c[buckets], minlength=n) / count for c in columns], axis=1) + model.bias if columns else np.zeros((n, 0))
                plain = np.concatenate(([0], np.cumsum(K.IS_LETTER[data] & (data < 128))))
                high = np.concatenate(([0], np.cumsum(data >= 128)))
                has = plain[offsets[1:]] > plain[offsets[:-1]]
                for i in np.flatnonzero(~has & (high[offsets[1:]] > high[offsets[:-1]])):
                    has[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode())
                if columns:
                    z = z / model.temperature
                    p = np.exp(z - z.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                for i in range(n):
                    if has[i] and columns:
                        j = int(p[i].argmax())
                        results.append({"lang": model.languages[j], "score": float(p[i, j]), "accepted": bool(p[i, j] >= model.threshold)})
                    else:
                        results.append({"lang": "und", "score": 0.0, "accepted": False})
            keep = [i for i, name in enumerate(batch.schema.names) if name != out]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(results, arrow)], names=[batch.schema.names[i] for i in keep] + [out])

    return df.mapInArrow(identify, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by a model that never saw the held-out third."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language(docs.filter(crc_mod(F.col("doc_id"), 3) != 1))
    return identify_language(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
        F.col("language.accepted").alias("accepted"),
    )
