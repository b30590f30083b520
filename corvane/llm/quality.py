"""Quality rules with line labels from a linear-chain CRF (operator 9).

One pass measures every text (words, characters in words, symbols, repeated lines, words in
repeated windows) and labels its lines: Viterbi decoding of a two-state linear-chain
conditional random field marks each line as content or boilerplate.  A document is kept if no
base rule fails it and content lines hold at least half of its words.

The field is trained in numpy on a bounded sample (``sample`` documents of each quality label,
the first by a hash of the id).  Labels are of documents, not of lines, so training runs twice:
first with every line labelled as its document, then with the lines of bad documents relabelled
by the first field.  A document is one chain, whatever its length.

Defined results: a null or empty text has no words, fails the word count and is not kept;
without labelled documents of both classes every line is content; texts of any length are
measured whole; repeated rows get equal results; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .io import sampled_labels, table

# The base measures.
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8

FEATURES = 11


def _set(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL, _ENDING, _UPPER, _DIGIT, _LOUD, _PIPE, _CONT = _set(SYMBOLS), _set(".!?:;"), _set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _set("0123456789"), _set("!?"), _set("|"), np.zeros(256, bool)
_CONT[0x80:0xC0] = True


def _total(mask: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(mask)))


def _repeats(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: is it equal to an earlier one of its row, to any other one."""
    with np.errstate(over="ignore"):
        own = hashes + K.mix(rows.astype(np.uint64), 9)
    order = np.argsort(own, kind="stable")
    same = np.zeros(len(own), bool)
    same[1:] = own[order[1:]] == own[order[:-1]]
    earlier, some = np.zeros(len(own), bool), np.zeros(len(own), bool)
    earlier[order] = same
    some[order] = same
    some[order[:-1]] |= same[1:]
    return earlier, some


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """Base measures by row; rows, word counts and features of the lines that have a word."""
    n = len(offsets) - 1
    starts, ends, rows = K.words(data, offsets)
    sums = K.prefix_sums(data)
    hashes = K.span_hashes(sums, starts, ends)
    chars, symbols = _total(~_CONT[data]), _total(_SYMBOL[data])
    letters = chars[ends] - chars[starts]

    first, keys = K.windows(hashes, rows, REPEAT_WINDOW)
    _, some = _repeats(rows[first], K.mix(keys, 10))
    change = np.bincount(first[some], minlength=len(rows) + 1) - np.bincount(first[some] + REPEAT_WINDOW, minlength=len(rows) + 1)
    repeated = (np.cumsum(change) > 0)[: len(rows)]

    line_start, line_end, line_row = K.runs(data != 10, offsets)
    words_before = np.concatenate((np.searchsorted(starts, line_start), np.searchsorted(starts, line_end))).reshape(2, -1)
    line_words = words_before[1] - words_before[0]
    has = line_words > 0
    line_start, line_end, line_row, line_words = line_start[has], line_end[has], line_row[has], line_words[has]
    earlier, _ = _repeats(line_row, K.span_hashes(sums, line_start, line_end))

    base = {
        "n_words": np.bincount(rows, minlength=n),
        "word_chars": K.sum_by_row(letters, rows, n),
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": np.bincount(line_row[earlier], minlength=n),
        "n_repeat_words": K.sum_by_row(repeated, rows, n),
    }
    span = lambda mask: (lambda t: t[line_end] - t[line_start])(_total(mask))
    size = np.maximum(chars[line_end] - chars[line_start], 1)
    last = ends[np.searchsorted(starts, line_end) - 1] - 1 if len(line_end) else line_end
    mean = size / line_words
    features = np.stack(
        [
            np.ones(len(size)),
            np.log1p(line_words) / 3,
            line_words < 4,
            np.minimum(5 * (symbols[line_end] - symbols[line_start]) / line_words, 2),
            np.minimum(5 * span(_PIPE[data]) / line_words, 2),
            _ENDING[data[last]] if len(last) else last,
            span(_UPPER[data]) / size,
            np.minimum(5 * span(_DIGIT[data]) / size, 2),
            np.minimum(3 * span(_LOUD[data]) / line_words, 2),
            np.minimum(np.abs(mean - 6) / 6, 2),
            earlier,
        ],
        axis=1,
    ).astype(float)
    return base, line_row, line_words, features


@dataclass
class LineField:
    """Scores of content against boilerplate: line weights, and start and step scores by state."""

    weights: np.ndarray
    start: np.ndarray
    step: np.ndarray


def _padded(rows: np.ndarray, n: int):
    """Place (document, turn) of each line and the length of each document."""
    at = K.row_starts(rows, n)
    return rows, np.arange(len(rows)) - at[rows], np.diff(at)


def viterbi(field: LineField, rows: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
    """Most likely states (1: content) of all lines; all documents advance together."""
    doc, turn, length = _padded(rows, n)
    states = np.ones(len(rows), np.int64)
    if not len(rows):
        return states
    emit = features @ field.weights
    at = K.row_starts(rows, n)[:-1]
    order = np.argsort(-length, kind="stable")
    best = np.zeros((n, 2))
    back = np.zeros((len(rows), 2), np.int64)
    for t in range(int(length.max())):
        live = order[: np.searchsorted(-length[order], -t, "left")]
        line = at[live] + t
        score = np.stack([np.zeros(len(live)), emit[line]], axis=1)
        if t == 0:
            best[live] = field.start + score
        else:
            ways = best[live][:, :, None] + field.step[None]
            back[line] = ways.argmax(axis=1)
            best[live] = ways.max(axis=1) + score
    now = best.argmax(axis=1)
    for t in range(int(length.max()) - 1, -1, -1):
        live = order[: np.searchsorted(-length[order], -t, "left")]
        line = at[live] + t
        states[line] = now[live]
        now[live] = back[line, now[live]]
    return states


def train_field(rows: np.ndarray, features: np.ndarray, labels: np.ndarray, n: int, steps: int = 120, rate: float = 0.1, l2: float = 1e-3) -> LineField:
    """Adam on the conditional likelihood; forward-backward runs over all documents at once.

    Lines are held turn by turn and, inside a turn, by descending length of their documents, so
    those that go on to the next turn are the first ones and no array is padded.
    """
    doc, turn, length = _padded(rows, n)
    by_length = np.argsort(-length, kind="stable")
    rank = np.argsort(by_length)[doc]
    order = np.lexsort((rank, turn))
    x, y, rank, turn = features[order], labels[order].astype(np.int64), rank[order], turn[order]
    length = length[by_length]
    length = length[length > 0]
    going = np.bincount(turn)
    at = np.concatenate(([0], np.cumsum(going)))
    last = at[length - 1] + np.arange(len(length))
    later = np.flatnonzero(turn > 0)
    earlier = at[turn[later] - 1] + rank[later]
    theta = np.zeros(x.shape[1] + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    parts = lambda th: (th[: x.shape[1]], th[-6:-4], th[-4:].reshape(2, 2))
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[earlier], y[later]), 1)
    for k in range(1, steps + 1):
        w, start, step = parts(theta)
        emit = np.stack([np.zeros(len(x)), x @ w], axis=1)
        ahead, behind = emit.copy(), np.zeros((len(x), 2))
        ahead[: going[0]] += start
        for t in range(1, len(going)):
            before, now = slice(at[t - 1], at[t - 1] + going[t]), slice(at[t], at[t + 1])
            ahead[now] += np.logaddexp(ahead[before, :1] + step[0], ahead[before, 1:] + step[1])
        for t in range(len(going) - 1, 0, -1):
            before, now = slice(at[t - 1], at[t - 1] + going[t]), slice(at[t], at[t + 1])
            on = behind[now] + emit[now]
            behind[before] = np.logaddexp(on[:, :1] + step[:, 0], on[:, 1:] + step[:, 1])
        z = np.logaddexp(ahead[last, 0], ahead[last, 1])
        p = np.exp(np.minimum(ahead + behind - z[rank][:, None], 0))
        grad = np.zeros_like(theta)
        grad[: x.shape[1]] = (p[:, 1] - y) @ x
        grad[-6:-4] = p[: going[0]].sum(axis=0) - np.bincount(y[: going[0]], minlength=2)
        both = ahead[earlier][:, :, None] + step + (emit[later] + behind[later])[:, None, :] - z[rank[later]][:, None, None]
        grad[-4:] = (np.exp(np.minimum(both, 0)).sum(axis=0) - seen).ravel()
        grad = grad / len(x) + l2 * theta
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return LineField(*parts(theta))


def _line_features(batches):
    kind = pa.schema([("label", pa.int32()), ("features", pa.list_(pa.list_(pa.float64())))])
    for batch in batches:
        labels = batch.column("label").to_pylist()
        for at, n, data, offsets in K.string_chunks(batch.column("text")):
            _, rows, _, features = measure(data, offsets)
            cuts = K.row_starts(rows, n)
            yield pa.RecordBatch.from_pylist([{"label": labels[at + i], "features": features[cuts[i] : cuts[i + 1]].tolist()} for i in range(n)], kind)


def fit_lines(labelled: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 500) -> LineField:
    """Field from at most ``sample`` documents of each label (0: bad, 1: good)."""
    rows = labelled.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(label).cast("int").alias("label")).filter("text IS NOT NULL AND label IN (0, 1)").withColumn("h", F.xxhash64("id", F.lit(9)))
    picked = [rows.filter(F.col("label") == y).orderBy("h", "id").limit(sample) for y in (0, 1)]
    found = picked[0].unionByName(picked[1]).select("h", "label", "text").repartition(8).select("label", "text").mapInArrow(_line_features, "label int, features array<array<double>>").collect()
    docs = sorted(((r.label, r.features) for r in found if r.features), key=lambda d: (d[0], len(d[1]), d[1]))
    if len({d[0] for d in docs}) < 2:
        return LineField(np.zeros(FEATURES), np.array([0.0, 1.0]), np.zeros((2, 2)))
    good = np.repeat([d[0] for d in docs], [len(d[1]) for d in docs])
    rows = np.repeat(np.arange(len(docs)), [len(d[1]) for d in docs])
    features = np.concatenate([np.asarray(d[1]) for d in docs])
    field = train_field(rows, features, good, len(docs))
    again = np.where(good == 1, 1, viterbi(field, rows, features, len(docs)))
    return train_field(rows, features, again, len(docs))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rate_quality(df: DataFrame, field: LineField, text: str = "text", out: str = "quality", least_words: int = 20, most_repeated: int = 30, least_content: float = 0.5) -> DataFrame:
    """``df`` with ``out``: struct of the base measures, ``content_words``, ``lines`` (0 or 1 for each
    line that has a word), ``base_failed`` and ``kept``."""
    kind = T.StructType([T.StructField(c, T.LongType()) for c in (*BASE, "content_words")] + [T.StructField("lines", T.ArrayType(T.IntegerType())), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, kind)])

    def rate(batches):
        for batch in batches:
            found = {c: [] for c in (*BASE, "content_words")}
            lines = []
            for _, n, data, offsets in K.string_chunks(batch.column(text)):
                base, rows, words, features = measure(data, offsets)
                states = viterbi(field, rows, features, n)
                for c in BASE:
                    found[c].append(base[c])
                found["content_words"].append(K.sum_by_row(words * states, rows, n))
                cuts = K.row_starts(rows, n)
                lines += [states[a:b].astype(np.int32) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            got = {c: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for c, v in found.items()}
            failed = (got["n_words"] < least_words) | (100 * got["n_repeat_words"] > most_repeated * got["n_words"])
            kept = ~failed & (got["content_words"] >= least_content * got["n_words"])
            columns = [pa.array(v) for v in got.values()] + [pa.array(lines, pa.list_(pa.int32())), pa.array(failed), pa.array(kept)]
            keep = [i for i, name in enumerate(batch.schema.names) if name != out]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.StructArray.from_arrays(columns, names=kind.names)], names=[batch.schema.names[i] for i in keep] + [out])

    return df.mapInArrow(rate, schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures, base rule and the field's verdict for all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = sampled_labels(docs, table(spark, sf_dir, "labels"), "quality", 500)
    field = fit_lines(docs.join(F.broadcast(labels), "doc_id"))
    rated = rate_quality(docs, field)
    return rated.select("doc_id", *(F.col(f"quality.{c}").alias(c) for c in BASE), F.col("quality.base_failed").alias("base_failed"), F.col("quality.kept").alias("kept"), F.col("quality.content_words").alias("content_words"))
