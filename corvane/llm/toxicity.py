"""Toxicity by multiple-instance learning (operator 4).

A document is a bag of sentences and toxic if at least one of them is: with sentence scores
p_s = sigmoid(b + sum of feature weights) it is toxic with the noisy-or 1 - (1 - leak) prod(1 - p_s).
The sentence scores are trained from document labels alone, by the gradient of that
likelihood; the leak, one of a document, takes up labels that no sentence explains.  Features are
the words of a sentence and their beginnings of 3 to 6 bytes, case folded.

The bag is a set: sentences with the same features are one instance, those without any are none.
A score combines, by the noisy-or, the sentences that offend by themselves (p_s >= 0.5); where there
are none it is the largest p_s.  So many harmless sentences never add up, a score does not follow the
length of a text or its repeats, and a document predicted toxic always has a located sentence.

Training reads a bounded sample: at most ``sample`` rows of each class, the first by a hash of
the id.  Tasks count the documents of each feature by class, Spark sums the counts, and the at
most ``features`` features with the largest z-score of the log odds ratio enter the model.  The
fitted weights are a few thousand numbers; scoring is one pass without a shuffle.

Defined results: a null or empty text, or one without letters, has no sentences and scores 0; without
training rows of both classes every score is 0; repeated rows score alike; texts of any length
are scored whole; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .io import crc_mod, sampled_labels, table, written

PREFIXES = (3, 4, 5, 6)
CLEAN = 4.0
_DELIMITER = np.zeros(256, bool)
_DELIMITER[[ord(c) for c in ".!?\n"]] = True


@dataclass
class ToxicityModel:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.hint = np.zeros(1 << 20, bool)
        self.hint[(self.features & np.uint64((1 << 20) - 1)).astype(np.int64)] = True


def _tokens(data, offsets):
    """Starts, rows and sentence numbers (ascending over all rows) of the tokens, and their ends."""
    starts, ends, rows = K.runs(K.IS_LETTER[data], offsets)
    breaks = np.cumsum(_DELIMITER[data]) if len(data) else np.zeros(0, np.int64)
    return starts, ends, rows, breaks[starts] + rows if len(starts) else starts


def _features(data, starts, ends):
    """(tokens, hashes) of the whole words and of each length of beginning."""
    sums = K.prefix_sums(data, fold=True)
    yield np.arange(len(starts)), K.mix(K.span_hashes(sums, starts, ends), 20)
    for k in PREFIXES:
        at = np.flatnonzero(ends - starts >= k)
        yield at, K.mix(K.span_hashes(sums, starts[at], starts[at] + k), 20 + k)


def _count_features(batches):
    for batch in batches:
        label = batch.column("label").to_numpy(zero_copy_only=False)
        found, n = [], 0
        for at, _, data, offsets in K.string_chunks(batch.column("text")):
            starts, ends, rows, _ = _tokens(data, offsets)
            for tokens, hashes in _features(data, starts, ends):
                row = rows[tokens]
                order = np.lexsort((row, hashes))
                h, r = hashes[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                found.append((h[new], label[at + r[new]]))
        if not found:
            continue
        hashes, labels = (np.concatenate(x) for x in zip(*found, strict=True))
        values, where = np.unique(hashes, return_inverse=True)
        positive = np.bincount(where, weights=labels, minlength=len(values)).astype(np.int64)
        every = np.bincount(where, minlength=len(values))
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(positive), pa.array(every - positive)], names=["feature", "pos", "neg"])


def _instances(features: np.ndarray):
    """The features of each document's distinct sentences that have any: sentence numbers and features."""
    model = ToxicityModel(features, np.zeros(len(features)), 0.0)

    def instances(batches):
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for at, n, data, offsets in K.string_chunks(batch.column("text")):
                starts, ends, rows, sentence = _tokens(data, offsets)
                which, index = _hits(model, data, starts, ends)
                numbers, first, where = _distinct(which, index, rows, sentence)
                kept = np.isin(sentence[which], numbers)
                which, index = which[kept], index[kept]
                order = np.lexsort((index, sentence[which]))
                which, index = which[order], index[order]
                cuts = np.searchsorted(rows[which], np.arange(n + 1))
                yield pa.RecordBatch.from_pylist(
                    [{"label": int(label[at + i]), "sentence": sentence[which[a:b]].tolist(), "feature": index[a:b].tolist()} for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))],
                    pa.schema([("label", pa.int32()), ("sentence", pa.list_(pa.int64())), ("feature", pa.list_(pa.int32()))]),
                )

    return instances


def _distinct(which, index, rows, sentence) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the sentences with features, but for those whose features another one of the same
    document has; a token of each, and for each hit which of all sentences with features it is in."""
    numbers, token, where = np.unique(sentence[which], return_index=True, return_inverse=True)
    if not len(numbers):
        return numbers, token, where
    with np.errstate(over="ignore"):
        own = np.zeros(len(numbers), np.uint64)
        np.add.at(own, where, K.mix(index.astype(np.uint64), 27))
    token = which[token]
    order = np.lexsort((numbers, own, rows[token]))
    new = np.ones(len(order), bool)
    new[1:] = (own[order[1:]] != own[order[:-1]]) | (rows[token][order[1:]] != rows[token][order[:-1]])
    kept = np.sort(order[new])
    return numbers[kept], token[kept], where


def _hits(model: ToxicityModel, data, starts, ends) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and indices of the model's features in them."""
    tokens, indices = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(model.features):
        for at, hashes in _features(data, starts, ends):
            maybe = np.flatnonzero(model.hint[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
            place = np.minimum(np.searchsorted(model.features, hashes[maybe]), len(model.features) - 1)
            real = model.features[place] == hashes[maybe]
            tokens.append(at[maybe[real]])
            indices.append(place[real])
    return np.concatenate(tokens), np.concatenate(indices)


def fit_noisy_or(docs: list, n_features: int, steps: int = 400, rate: float = 0.1, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the noisy-or likelihood with a leak.

    ``docs``: (label, sentence numbers, feature indices); the last two are parallel.
    """
    sent, feat, doc_of, labels = [], [], [], []
    for d, (label, sentences, features) in enumerate(docs):
        own, where = np.unique(np.asarray(sentences, np.int64), return_inverse=True)
        sent.append(where + len(doc_of))
        feat.append(np.asarray(features, np.int64))
        doc_of += [d] * len(own)
        labels.append(label)
    sent, feat = np.concatenate(sent), np.concatenate(feat)
    doc_of, y = np.asarray(doc_of, np.int64), np.asarray(labels, float)
    weight_of = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    theta = np.zeros(n_features + 2)  # weights, bias, leak
    theta[-2:] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        s = theta[-2] + np.bincount(sent, weights=theta[feat], minlength=len(doc_of))
        p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        leak = 1 / (1 + np.exp(-np.clip(theta[-1], -30, 30)))
        log_clean = np.log1p(-leak) + np.bincount(doc_of, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y))
        clean = np.exp(log_clean)
        pull = weight_of * np.where(y == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0)
        g_s = pull[doc_of] * p
        grad = np.empty_like(theta)
        grad[:-2] = np.bincount(feat, weights=g_s[sent], minlength=n_features) + l2 * theta[:-2]
        grad[-2:] = g_s.sum(), (pull * leak).sum()
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return theta[:-2], float(theta[-2])


def shifted(docs: list, weights: np.ndarray, bias: float, most: float = 2.0) -> float:
    """The bias with which the smallest shares of the training documents fall on the wrong side of 0.5.

    Training lets several weak sentences explain a label together, while a score of 0.5 takes one
    sentence.  A share of clean documents counts ``CLEAN`` times as much as one of toxic ones.  The
    shift is at most ``most``, and the smallest of equally good ones.
    """
    highest = np.full(len(docs), -30.0)
    for d, (_, sentences, features) in enumerate(docs):
        if len(sentences):
            _, where = np.unique(np.asarray(sentences, np.int64), return_inverse=True)
            highest[d] = bias + np.bincount(where, weights=weights[np.asarray(features, np.int64)]).max()
    y = np.array([d[0] for d in docs])
    values = np.unique(highest[np.abs(highest) <= most])
    cuts = np.concatenate(([0.0], (values[1:] + values[:-1]) / 2))
    wrong = [(highest[y == 1] < t).mean() + CLEAN * (highest[y == 0] >= t).mean() for t in cuts]
    return bias - float(cuts[np.lexsort((np.abs(cuts), wrong))[0]])


def fit_toxicity(labelled: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 3000, features: int = 2048, z_least: float = 2.5) -> ToxicityModel:
    """Model from rows with a label of 0 or 1; ``sample`` bounds the rows used of each class."""
    rows = labelled.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(label).cast("int").alias("label")).filter("text IS NOT NULL AND label IN (0, 1)")
    rows = rows.withColumn("h", F.xxhash64("id", F.lit(4)))
    picked = [rows.filter(F.col("label") == y).orderBy("h", "id").limit(sample) for y in (0, 1)]
    rows = written(picked[0].unionByName(picked[1]).select("label", "text").repartition(16))
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    none = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), -30.0)
    if len(n) < 2:
        return none
    counts = rows.mapInArrow(_count_features, "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    p, q = F.col("pos") + 0.5, F.col("neg") + 0.5
    z = (F.log(p / (n[1] - F.col("pos") + 0.5)) - F.log(q / (n[0] - F.col("neg") + 0.5))) / F.sqrt(1 / p + 1 / q)
    chosen = counts.filter("pos + neg >= 3").withColumn("z", z).filter(F.col("z") >= z_least).orderBy(F.col("z").desc(), "feature").limit(features).select("feature").toPandas()
    hashes = np.sort(chosen["feature"].to_numpy(np.int64).view(np.uint64))
    if not len(hashes):
        return none
    found = rows.mapInArrow(_instances(hashes), "label int, sentence array<long>, feature array<int>").toArrow().combine_chunks()
    label = found["label"].to_numpy()
    lists = found["sentence"].combine_chunks(), found["feature"].combine_chunks()
    sentence, feature = (x.flatten().to_numpy() for x in lists)
    at = lists[0].offsets.to_numpy() - lists[0].offsets[0].as_py()
    docs = [(label[i], sentence[at[i] : at[i + 1]], feature[at[i] : at[i + 1]]) for i in range(len(label))]
    docs.sort(key=lambda d: (d[0], len(d[1]), d[2].tolist(), d[1].tolist()))  # the order of collected rows is not fixed
    weights, bias = fit_noisy_or(docs, len(hashes))
    return ToxicityModel(hashes, weights, shifted(docs, weights, bias))


_SENTENCES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``df`` with ``out`` (struct of ``score`` and ``sentences``).

    ``sentences`` locates what offends: (start, end, score) in code points of every sentence that
    scores at least 0.5 by itself.
    """
    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("sentences", _SENTENCES)])
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, kind)])
    arrow = pa.struct([("score", pa.float64()), ("sentences", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))])

    def score(batches):
        for batch in batches:
            results = []
            for _, n, data, offsets in K.string_chunks(batch.column(text)):
                starts, ends, rows, sentence = _tokens(data, offsets)
                which, index = _hits(model, data, starts, ends)
                hit, token, where = np.unique(sentence[which], return_index=True, return_inverse=True)
                s = model.bias + np.bincount(where, weights=model.weights[index], minlength=len(hit)) if len(hit) else np.zeros(0)
                p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
                token = which[token]
                row = rows[token]
                own, _, _ = _distinct(which, index, rows, sentence)
                bad = (p >= 0.5) & np.isin(hit, own)
                log_clean = np.bincount(row[bad], weights=np.log1p(-np.minimum(p[bad], 1 - 1e-12)), minlength=n)
                highest = np.zeros(n)
                np.maximum.at(highest, row, p)
                scores = np.where(highest >= 0.5, -np.expm1(log_clean), highest)
                marked = [[] for _ in range(n)]
                if (p >= 0.5).any():
                    breaks = np.flatnonzero(_DELIMITER[data])
                    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                    for j in np.flatnonzero(p >= 0.5):
                        r = int(row[j])
                        at = np.searchsorted(breaks, starts[token[j]])
                        a = max(int(offsets[r]), int(breaks[at - 1]) + 1 if at else 0)
                        b = min(int(offsets[r + 1]), int(breaks[at]) + 1 if at < len(breaks) else len(data))
                        zero = chars[offsets[r]]
                        marked[r].append({"start": int(chars[a] - zero), "end": int(chars[b] - zero), "score": float(p[j])})
                results += [{"score": float(x), "sentences": m} for x, m in zip(scores, marked, strict=True)]
            keep = [i for i, name in enumerate(batch.schema.names) if name != out]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(results, arrow)], names=[batch.schema.names[i] for i in keep] + [out])

    return df.mapInArrow(score, schema)


def labelled_documents(spark: SparkSession, docs: DataFrame, sf_dir: str, sample: int = 3000) -> DataFrame:
    """A bounded sample of documents with the toxic label, without the held-out fifth."""
    usable = docs.select("doc_id", "text").filter(crc_mod(F.col("doc_id"), 5) != 0)
    labels = table(spark, sf_dir, "labels").filter(crc_mod(F.col("doc_id"), 5) != 0)
    return usable.join(F.broadcast(sampled_labels(usable, labels, "toxic", sample)), "doc_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model that never saw the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(labelled_documents(spark, docs, sf_dir))
    return score_toxicity(docs, model).select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"),
        F.col("toxicity.sentences").alias("sentences"),
    )
