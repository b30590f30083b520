"""Language of texts by rank-order n-gram profiles (Cavnar and Trenkle, 1994).

A profile lists the most frequent 1- to 3-letter sequences of a language, words in lower case with a
blank on either side, by rank.  A text's own ranking is held against each profile: the sum of how far
each of its sequences stands from its place there, a missing one counting as the length of the profile.
The nearest profile wins, if it is nearer than the second by a margin.

Profiles are learnt in Spark from all rows of a labelled table; tasks send on one row for each
language and sequence.  What detection carries to the tasks is ``size`` rows a language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LETTERS = re.compile(r"[^\W\d_]+")
_SPACE = np.uint64(32)
#: Sequences in a profile, relative lead of the nearest, characters below which nothing is said, and languages at most.
SIZE, MARGIN, LEAST_CHARS, MOST_LANGUAGES = 300, 0.03, 40, 1000
#: Characters whose sequences a task holds at a time, each about a hundred bytes.
PORTION = 1 << 18
#: Different sequences of a language that a task gathers before it sends their counts on.
HELD = 1 << 18


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, sequences as numbers) of all texts, in one pass over their code points."""
    lines = [" " + " ".join(_LETTERS.findall((t or "").lower())) + " " for t in texts]
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    rows, found = [], []
    code = np.zeros(len(codes), np.uint64)
    for n in range(1, 4):
        size = max(len(codes) - n + 1, 0)
        code = (code[:size] << np.uint64(21)) | codes[n - 1 :]
        # inside a row, no blank in the middle, not a blank alone
        fine = (row[:size] == row[n - 1 :]) & ((codes[:size] != _SPACE) | (codes[n - 1 :] != _SPACE))
        if n == 3:
            fine &= codes[1 : size + 1] != _SPACE
        rows.append(row[:size][fine])
        found.append(code[fine])
    return np.concatenate(rows), np.concatenate(found)


def portions(texts: list[str | None], most: int = PORTION) -> Iterator[slice]:
    """Runs of texts of about ``most`` characters; a longer text is one of its own."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > begin and held + n > most:
            yield slice(begin, i)
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield slice(begin, len(texts))


def ranked(rows: np.ndarray, grams: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, sequence, rank) of the ``size`` most frequent sequences of each row; ties by the sequence."""
    if not len(rows):
        return rows, grams, rows
    order = np.lexsort((grams, rows))
    rows, grams = rows[order], grams[order]
    new = np.append(True, (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1]))
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(rows)))
    rows, grams = rows[start], grams[start]
    order = np.lexsort((grams, -count, rows))
    rows, grams = rows[order], grams[order]
    first = np.searchsorted(rows, rows)
    rank = np.arange(len(rows)) - first
    return rows[rank < size], grams[rank < size], rank[rank < size]


def learn_profiles(labelled: DataFrame, label: str = "lang", text: str = "text", size: int = SIZE) -> DataFrame:
    """(language, gram, rank): the profile of each non-null label."""

    def counts_of(lang: str, of: dict[int, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(of)), pa.array(np.fromiter(of, np.uint64, len(of)).view(np.int64)), pa.array(list(of.values()), pa.int64())], ["language", "gram", "n"])

    def count(batches: Iterator[pa.RecordBatch]):
        total: dict[str, dict[int, int]] = {}
        for b in batches:
            labels, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in set(labels):
                own = [t for t, g in zip(texts, labels, strict=True) if g == lang]
                of = total.setdefault(lang, {})
                for part in portions(own):
                    _, grams = ngrams(own[part])
                    for g, n in zip(*(x.tolist() for x in np.unique(grams, return_counts=True)), strict=True):
                        of[g] = of.get(g, 0) + n
                if len(of) > HELD:
                    yield counts_of(lang, total.pop(lang))
        for lang, of in total.items():
            yield counts_of(lang, of)

    counted = labelled.filter(F.col(label).isNotNull()).select(F.col(label).alias("language"), text).mapInArrow(count, "language string, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "gram"))
    return counted.withColumn("rank", place - 1).filter(F.col("rank") < size).select("language", "gram", "rank")


def detector(profiles: DataFrame, size: int = SIZE, margin: float = MARGIN, least_chars: int = LEAST_CHARS):
    """A function of a text column that gives (language, lead): the nearest profile, null when unsure, and by how much it leads.

    Null too: texts below ``least_chars`` trimmed characters or without letters, and all texts when nothing was learnt.
    """
    if profiles.select("language").distinct().count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rows = profiles.orderBy("language", "gram").toPandas()
    names = sorted(rows["language"].unique())
    known = np.unique(rows["gram"].to_numpy(np.int64))
    places = np.full((len(names), len(known) + 1), -1)
    for k, name in enumerate(names):
        of = rows[rows["language"] == name]
        places[k, np.searchsorted(known, of["gram"])] = of["rank"]

    def nearest(texts: pd.Series) -> pd.DataFrame:
        n = len(texts)
        out = pd.DataFrame({"language": [None] * n, "lead": [None] * n})
        row, gram, rank = ranked(*ngrams(texts.tolist()), size)
        if not len(row) or not names:
            return out
        at = np.searchsorted(known, gram.view(np.int64))
        at[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != gram.view(np.int64))] = len(known)
        apart = np.where(places[:, at] >= 0, np.minimum(np.abs(places[:, at] - rank), size), size)
        distance = np.stack([np.bincount(row, weights=a, minlength=n) for a in apart], axis=1)
        order = np.argsort(distance, axis=1, kind="stable")
        best = distance[np.arange(n), order[:, 0]]
        second = distance[np.arange(n), order[:, 1]] if len(names) > 1 else np.bincount(row, minlength=n) * float(size)
        lead = np.divide(second - best, second, out=np.zeros(n), where=second > 0)
        some = (np.bincount(row, minlength=n) > 0) & np.array([t is not None and len(t.strip()) >= least_chars for t in texts])
        out["language"] = [names[k] if s and x >= margin else None for k, s, x in zip(order[:, 0], some, lead, strict=True)]
        out["lead"] = [x if s else None for x, s in zip(lead, some, strict=True)]
        return out

    @F.pandas_udf("language string, lead double")
    def detect(texts: pd.Series) -> pd.DataFrame:
        found = [nearest(texts.iloc[part]) for part in portions(texts.tolist())]
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"language": [], "lead": []})

    return detect


def chunk_language(language: Column) -> Column:
    """The three values that chunks carry: de, en or other; null stays null."""
    return F.when(language.isin("de", "en"), language).when(language.isNotNull(), "other")
