"""Benchmark decontamination by pigeonhole edit matching (operator 7).

A test item may occur in a document with up to ``budget`` edits, a share of its length.  Cut
into budget + 1 pieces, at least one piece must occur unchanged in any such occurrence.  One
Aho-Corasick pass over every whole text finds the exact piece hits; each hit fixes where the
item would stand, overlapping stretches are joined, and Myers' bit-parallel algorithm gives the edit
distance of the item to each.  So an item costs at most one pass over a text, however often its
pieces occur.

The test items are the stated query set.  They are read in blocks of about ``block`` characters,
which bounds what a task holds whatever the number of items; documents are never shuffled.

Texts are compared with letters lower-cased and white space as one space.  An item too short for an
edit (under 20 characters at the usual rate) matches whole words only: neither end may stand inside a
word.  Defined results: a null or empty document or item matches nothing; repeated items are reported
under each of their ids, a null id too; different texts with one id are each searched and reported; repeated documents each report their own matches, and so do rows with a null or repeated
id; of occurrences with the same distance the first is reported; texts of any length are read
whole; without items or documents there are no matches; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import table, written


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(place, text) of budget + 1 nearly equal pieces."""
    n, k = len(item), budget + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def best_occurrence(pattern: str, text: str) -> tuple[int, int]:
    """(distance, end) of the substring of ``text`` nearest to ``pattern`` (Myers, bit-parallel)."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = (m, 0)
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best


def stretches(starts: list[int], size: int, budget: int) -> list[tuple[int, int]]:
    """Where items that would start at the ascending ``starts`` can stand; overlapping stretches are one."""
    out: list[tuple[int, int]] = []
    for s in starts:
        a, b = max(0, s - budget), s + size + budget
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def stands_alone(text: str, a: int, b: int) -> bool:
    """Does text[a:b] start and end at word edges?"""
    return not (a > 0 and text[a - 1].isalnum() and text[a].isalnum()) and not (b < len(text) and text[b - 1].isalnum() and text[b].isalnum())


def _matches(items: list[tuple[int | None, str]], rate: float):
    """Task function: documents to matches with a block of items."""

    def match(batches):
        import ahocorasick

        texts = [normalised(t) for _, t in items]
        budgets = [int(len(t) * rate) for t in texts]
        automaton = ahocorasick.Automaton()
        where: dict[str, list] = {}
        for i, t in enumerate(texts):
            for place, piece in pieces(t, budgets[i]):
                where.setdefault(piece, []).append((i, place))
        for piece, uses in where.items():
            automaton.add_word(piece, (len(piece), uses))
        if where:
            automaton.make_automaton()
        for batch in batches:
            out = {"doc_id": [], "item_id": [], "distance": [], "start": [], "end": []}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = normalised(text)
                if not text or not where:
                    continue
                found: dict[int, tuple] = {}
                starts: dict[int, set[int]] = {}
                for end, (size, uses) in automaton.iter(text):
                    for i, place in uses:
                        starts.setdefault(i, set()).add(end + 1 - size - place)
                for i, at in starts.items():
                    k, item = budgets[i], texts[i]
                    if not k:
                        whole = next((a for a in sorted(at) if stands_alone(text, a, a + len(item))), None)
                        if whole is not None:
                            found[i] = (0, whole, whole + len(item))
                        continue
                    for a, b in stretches(sorted(at), len(item), k):
                        whole = text.find(item, a, b)
                        if whole >= 0:
                            distance, stop = 0, whole + len(item)
                        else:
                            distance, stop = best_occurrence(item, text[a:b])
                            stop += a
                        if distance <= k and (i not in found or distance < found[i][0]):
                            found[i] = (distance, max(0, stop - len(item)), stop)
                        if distance == 0:
                            break
                for i, (distance, a, b) in sorted(found.items()):
                    for name, value in zip(out, (doc, items[i][0], distance, a, b), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(c, pa.int64()) for c in out]))

    return match


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = 0.05, block: int = 1 << 24) -> DataFrame:
    """(doc_id, item_id, distance, start, end): the nearest occurrence of every item in every document.

    An item matches within int(``rate`` * length) edits; start and end are places in the
    normalised text, the start to within the edits.
    """
    items = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).filter("text IS NOT NULL").distinct()
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block))
    if blocks > 1:  # even blocks by a hash, in one written table
        items = written(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * blocks))))
    else:
        items = items.withColumn("block", F.lit(0))
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, distance long, start long, end long"
    out = None
    for b in range(2 * blocks if blocks > 1 else 1):
        rows = [(r.item_id, r.text) for r in items.filter(F.col("block") == b).select("item_id", "text").collect()]
        part = source.mapInArrow(_matches(rows, rate), schema)
        out = part if out is None else out.unionByName(part)
    return out


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and benchmark items that they contain within 5 % of edits."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).distinct()
