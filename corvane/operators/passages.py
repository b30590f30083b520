"""Where a query's words stand in a chunk: cover density and headlines.

Both take words as equal when their stems are, German with weight A or English with weight B, and both
look at the words of a chunk at a time, for all queries at once.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stems import ENGLISH_STOP, GERMAN_STOP, stems, with_stems
from ..functions.text import collapse, words_without
from ..sources.shared import written
from .lexical import MARK, SMALL_CHARS, SMALL_ROWS, TOKEN, UNMARK, small_side
from .postings import WEIGHT_A, WEIGHT_B, lexemes

#: Between the fragments of a headline.
ELLIPSIS = " … "


def query_items(queries: DataFrame) -> DataFrame:
    """(query_id, item, term, weight): the lexemes of each distinct word of a query that is no stopword in both languages."""
    words = queries.select("query_id", F.explode(F.array_distinct(words_without("query", set(GERMAN_STOP) | set(ENGLISH_STOP)))).alias("word"))
    stemmed = with_stems(words).select("query_id", F.concat_ws(" ", "german", "english").alias("item"), "german", "english").distinct()
    both = F.array(F.struct(F.col("german").alias("term"), F.lit("A").alias("weight")), F.struct(F.col("english").alias("term"), F.lit("B").alias("weight")))
    return stemmed.select("query_id", "item", F.inline(both)).filter("term <> ''")


def minimal_covers(positions, items) -> list[tuple[int, int]]:
    """First and last position of each stretch that holds all items and no shorter stretch that does.

    ``positions`` ascend; one sweep with two ends, the left one never goes back.
    """
    lacking, seen, left = len(set(items)), dict.fromkeys(items, 0), 0
    found: list[tuple[int, int]] = []
    for right, (p, item) in enumerate(zip(positions, items, strict=True)):
        lacking -= seen[item] == 0
        seen[item] += 1
        if right + 1 < len(positions) and positions[right + 1] == p:
            continue
        while seen[items[left]] > 1:
            seen[items[left]] -= 1
            left += 1
        if not lacking and (not found or positions[left] > found[-1][0]):
            found.append((positions[left], p))
    return found


def cover_score(positions, items, weights) -> float:
    """Sum over minimal covers: the harmonic mean of the weights of the matched places over one plus the other places in it."""
    place = {}
    for p, w in zip(positions, weights, strict=True):
        place[p] = max(w, place.get(p, 0.0))
    at = sorted(place)
    inverse = np.concatenate(([0.0], np.cumsum([1.0 / place[p] for p in at])))
    total = 0.0
    for a, b in minimal_covers(positions, items):
        i, j = np.searchsorted(at, (a, b + 1))
        matched = int(j - i)
        total += matched / (inverse[j] - inverse[i]) / (1 + (b - a + 1) - matched)
    return total


def cover_scores(group: np.ndarray, position: np.ndarray, item: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row, number of items, cover_score) of each group of the rows, which are sorted by group and position.

    A cover that ends at a row begins at the first row whose item does not come again up to there, and that is
    where the running maximum of the items' next rows exceeds the row.
    """
    n = len(group)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    new = np.append(True, group[1:] != group[:-1])
    first, of = np.flatnonzero(new), np.cumsum(new) - 1
    end = np.append(first[1:], n)
    order = np.lexsort((item, of))  # stable: by place inside an item
    same = (of[order][1:] == of[order][:-1]) & (item[order][1:] == item[order][:-1])
    later = end[of]
    later[order[:-1][same]] = order[1:][same]
    earliest = np.ones(n, bool)
    earliest[order[1:][same]] = False
    seen = np.cumsum(earliest)
    items = np.add.reduceat(earliest.astype(np.int64), first)
    whole = seen - (seen[first] - 1)[of] == items[of]
    begins = new | np.append(True, position[1:] != position[:-1])
    place = np.cumsum(begins) - 1  # places are numbered over all groups
    inverse = np.concatenate(([0.0], np.cumsum(1.0 / np.maximum.reduceat(weight, np.flatnonzero(begins)))))
    right = np.flatnonzero(whole & np.append(begins[1:], True))  # the last row of a place
    left = np.searchsorted(np.maximum.accumulate(later), right, side="right")
    a, b = place[left], place[right]
    shorter = np.append(True, a[1:] != a[:-1])
    a, b, left, right = a[shorter], b[shorter], left[shorter], right[shorter]
    matched = b - a + 1
    part = matched / (inverse[b + 1] - inverse[a]) / (1 + (position[right] - position[left] + 1) - matched)
    return first, items, np.bincount(of[right], weights=part, minlength=len(first))


#: Rows (query, place in a chunk) that a task scores at a time.
AT_ONCE = 1 << 20


def _asked_words(asked: DataFrame) -> pd.DataFrame | None:
    """The rows (query_id, item, term, weight) of a user's queries if a count of rows and characters allows it."""
    n, chars = asked.agg(F.count("*"), F.coalesce(F.sum(F.length("term") + F.length("item")), F.lit(0))).first()
    return asked.toPandas() if n <= SMALL_ROWS and chars <= SMALL_CHARS else None


def _covered(asked: pd.DataFrame):
    """Chunks (chunk_id, text in lower case) to (query_id, chunk_id, n_items, covers) of all queries with a word in them.

    Words are stemmed in the task, so what it holds depends on the queries only: the words that match the
    same terms share their places in the queries.
    """
    queries, query_of = np.unique(asked["query_id"].to_numpy(np.int64), return_inverse=True)
    _, item_of = np.unique(asked["item"].to_numpy(str), return_inverse=True)
    terms: dict[tuple[str, str], list[tuple[int, int]]] = {}
    for key, q, i in zip(zip(asked["term"], asked["weight"], strict=True), query_of.tolist(), item_of.tolist(), strict=True):
        terms.setdefault(key, []).append((q, i))
    numbers: dict[tuple, int] = {}
    places: list[np.ndarray] = []

    def number_of(word: str) -> int:
        """Of the places (query, item, weight) that a word matches, -1 without any."""
        sides = ((stem, weight) for stem, weight, stop in zip(stems(word), "AB", (GERMAN_STOP, ENGLISH_STOP), strict=True) if word not in stop)
        met = tuple(side for side in sides if side in terms)
        if met and met not in numbers:
            best: dict[tuple[int, int], float] = {}
            for side in reversed(met):  # the greater weight comes last
                best.update(dict.fromkeys(terms[side], WEIGHT_A if side[1] == "A" else WEIGHT_B))
            numbers[met] = len(places)
            places.append(np.array([(*at, w) for at, w in best.items()]))
        return numbers[met] if met else -1

    def score(row, position, number, start, query, item, weight):
        count = start[number + 1] - start[number]
        at = np.repeat(start[number] - np.cumsum(count) + count, count) + np.arange(count.sum())
        # tokens stand in order, so a stable sort by pair leaves places in order
        pair = np.repeat(row, count) * len(queries) + query[at]
        by = np.argsort(pair, kind="stable")
        pair = pair[by]
        first, items, covers = cover_scores(pair, np.repeat(position, count)[by], item[at][by], weight[at][by])
        row, q = np.divmod(pair[first], len(queries))
        return row, queries[q], items, covers

    def covered(batches):
        known = 0
        start, flat = np.zeros(1, np.int64), np.zeros((0, 3))
        for batch in batches:
            if not len(queries) or not batch.num_rows:
                continue
            found = [TOKEN.findall(t) if t else [] for t in batch.column("text").to_pylist()]
            size = np.array([len(x) for x in found])
            tokens = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
            of = np.array([number_of(w) for w in tokens.dictionary.to_pylist()], np.int64)
            number = of[tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
            if known < len(places):
                known = len(places)
                start, flat = np.concatenate(([0], np.cumsum([len(x) for x in places]))), np.concatenate(places)
            query, item, weight = flat[:, 0].astype(np.int64), flat[:, 1].astype(np.int64), flat[:, 2]
            row = np.repeat(np.arange(len(found)), size)
            position = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            hit = np.flatnonzero(number >= 0)
            row, position, number = row[hit], position[hit], number[hit]
            # whole chunks in portions of bounded rows
            grown = np.cumsum(start[number + 1] - start[number])
            part = np.zeros(len(found), np.int64)
            np.maximum.at(part, row, grown // AT_ONCE)
            part = np.maximum.accumulate(part)[row]
            for cut in np.split(np.arange(len(row)), np.flatnonzero(np.diff(part)) + 1):
                r, q, items, covers = score(row[cut], position[cut], number[cut], start, query, item, weight)
                yield pa.RecordBatch.from_arrays([pa.array(q), batch.column("chunk_id").take(pa.array(r)), pa.array(items), pa.array(covers)], names=["query_id", "chunk_id", "n_items", "covers"])

    return covered


def cover_density(queries: DataFrame, chunks: DataFrame, need: str = "present") -> DataFrame:
    """(query_id, chunk_id, n_items, score) of chunks with a word of the query.

    ``need="all"``: covers of all words of the query, other chunks score 0.  ``need="present"``: covers of
    the words that the chunk has, times their share of the query's.

    Chunks are scored in the tasks that cut them, for all queries at once: nothing is shuffled but the chunks' ids.  Rows that repeat an id are one chunk, and too many words of queries for the
    tasks are joined instead.
    """
    if need not in ("all", "present"):
        raise ValueError(need)
    asked = query_items(queries)
    sizes = asked.groupBy("query_id").agg(F.countDistinct("item").alias("n_asked"))
    met = _asked_words(asked) if dict(queries.dtypes)["query_id"] in ("bigint", "int") and queries.filter("query_id IS NULL").isEmpty() else None
    if met is None:
        scored = _joined_covers(asked, chunks)
    else:
        repeated = written(chunks.groupBy("chunk_id").count().filter("count > 1").select("chunk_id"))
        again = None
        if not repeated.isEmpty():
            same = F.col("c.chunk_id").eqNullSafe(F.col("r.chunk_id"))
            again = _joined_covers(asked, chunks.alias("c").join(repeated.alias("r"), same, "left_semi"))
            chunks = chunks.alias("c").join(repeated.alias("r"), same, "left_anti")
        kind = dict(chunks.dtypes)["chunk_id"]
        scored = chunks.select("chunk_id", F.lower("text").alias("text")).mapInArrow(_covered(met), f"query_id long, chunk_id {kind}, n_items long, covers double")
        scored = scored if again is None else scored.unionByName(again)
    scored = scored.join(small_side(sizes, F.lit("")), "query_id")
    score = F.when(F.col("n_items") == F.col("n_asked"), F.col("covers")).otherwise(F.lit(0.0)) if need == "all" else F.col("covers") * F.col("n_items") / F.col("n_asked")
    return scored.select("query_id", "chunk_id", F.col("n_items").cast("long").alias("n_items"), score.alias("score"))


def _joined_covers(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, n_items, covers) by a join of the words, whose places meet in a row for each pair."""
    weight = F.when(F.col("weight") == "A", F.lit(WEIGHT_A)).otherwise(F.lit(WEIGHT_B))
    hits = lexemes(chunks, "chunk_id").join(asked, ["term", "weight"]).groupBy("query_id", "chunk_id", "position", "item").agg(F.max(weight).alias("w"))
    rows = hits.groupBy("query_id", "chunk_id").agg(F.sort_array(F.collect_list(F.struct("position", "item", "w"))).alias("hits"), F.countDistinct("item").alias("n_items"))

    @F.pandas_udf("double")
    def swept(hits: pd.Series) -> pd.Series:
        return pd.Series([cover_score([h["position"] for h in x], [h["item"] for h in x], [h["w"] for h in x]) for x in hits])

    return rows.select("query_id", "chunk_id", "n_items", swept("hits").alias("covers"))


def fragments(matches, n: int, least: int, most: int, count: int = 2) -> list[tuple[int, int]]:
    """Up to ``count`` disjoint stretches of at most ``most`` of ``n`` words, with as many matches as possible.

    Weighted interval scheduling over the windows that start at a match, from the last to the first; of
    equal choices, fewer stretches, then earlier ones.  A stretch ends with its last match, or has
    ``least`` words where the text allows it.
    """
    m = np.unique(np.asarray(matches, np.int64))
    if not len(m):
        return []
    after = np.searchsorted(m, m + most)  # the first match outside the window
    inside = after - np.arange(len(m))
    best = np.zeros((count + 1, len(m) + 1), np.int64)
    for c in range(1, count + 1):
        for i in range(len(m) - 1, -1, -1):
            best[c, i] = max(best[c, i + 1], inside[i] + best[c - 1, after[i]])
    wanted = next(c for c in range(1, count + 1) if best[c, 0] == best[count, 0])
    out: list[tuple[int, int]] = []
    i = 0
    for c in range(wanted, 0, -1):
        while best[c, i + 1] == best[c, i]:
            i += 1
        a, b = int(m[i]), int(m[after[i] - 1]) + 1
        b = min(max(b, a + least), n)
        out.append((max(min(a, b - least), out[-1][1] if out else 0, 0), b))
        i = int(after[i])
    return out


def headlines(hits: DataFrame, queries: DataFrame, least: int = 6, most: int = 18, fallback: int = 240) -> DataFrame:
    """(query_id, chunk_id, headline) of hits (query_id, chunk_id, text, language).

    Words whose stem, German in chunks of language ``de`` and English in others, is a stem of a query word
    stand in ⟦…⟧; up to two fragments with the most of them are given.  Without any it is the start of the text.
    """
    pairs = hits.select("query_id", "chunk_id", F.coalesce("language", F.lit("")).alias("language"), collapse(F.col("text")).alias("text"))
    words = pairs.select("query_id", "chunk_id", "language", F.posexplode(F.split("text", " ")).alias("position", "raw"))
    bare = with_stems(words.select("query_id", "chunk_id", "language", "position", F.explode(words_without("raw", ())).alias("word")))
    german = F.col("language") == "de"
    term, weight = F.when(german, F.col("german")).otherwise(F.col("english")), F.when(german, "A").otherwise("B")
    matched = bare.withColumn("term", term).withColumn("weight", weight).join(query_items(queries).select("query_id", "term", "weight").distinct(), ["query_id", "term", "weight"])
    places = matched.groupBy("query_id", "chunk_id").agg(F.sort_array(F.collect_set("position")).alias("places"))

    @F.pandas_udf("string")
    def shown(texts: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for text, at in zip(texts, places, strict=True):
            at = [] if at is None else list(at)
            words, marked = text.split(" ") if text is not None else [], set(at)
            parts = [" ".join(f"{MARK}{w}{UNMARK}" if k in marked else w for k, w in enumerate(words[a:b], a)) for a, b in fragments(at, len(words), least, most)]
            out.append(ELLIPSIS.join(parts) if parts else (text or "")[:fallback])
        return pd.Series(out)

    return pairs.join(places, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", shown("text", "places").alias("headline"))
