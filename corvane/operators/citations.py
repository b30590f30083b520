"""Citation markers, highlights, routing against titles, and other table-level text operators."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CITATION, SUMMARY_WORDS, collapse, content_tokens, corpus_intent, query_breadth, split_questions, strip_citations, trim_all
from ..sources.shared import written

MERGE_GAP = 6
#: Titles up to which a word of theirs is joined with queries by itself.
RARE = 64
#: Letters and digits.
WORD = re.compile(r"[^\W_]+")


def extract_citations(df: DataFrame, id: str = "message_id", text: str = "content") -> DataFrame:
    """(id, seq, doc_id, chunk_id, start, end): every marker in order; places count from 0."""
    whole = F.regexp_extract_all(text, F.lit(f"({CITATION})"), F.lit(1))
    plain = F.split(F.col(text), CITATION, -1)
    # one row a marker with the length of what stands before it; places are running sums over a text's markers
    out = df.withColumn("_row", F.monotonically_increasing_id()).select(id, "_row", F.posexplode(F.arrays_zip(whole.alias("marker"), F.transform(plain, F.length).alias("gap"))).alias("seq", "x"))
    out = out.filter("x.marker IS NOT NULL").select(id, "_row", "seq", "x.marker", "x.gap")
    end = F.sum(F.col("gap") + F.length("marker")).over(Window.partitionBy("_row").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    number = lambda g: F.regexp_extract("marker", CITATION, g).cast("long")
    return out.withColumn("end", end.cast("long")).select(id, F.col("seq").cast("long").alias("seq"), number(1).alias("doc_id"), number(2).alias("chunk_id"), (F.col("end") - F.length("marker")).alias("start"), "end")


def number_citations(citations: DataFrame, allowed: DataFrame | None = None, id: str = "message_id") -> DataFrame:
    """Index by first mention of each pair; pairs outside the allowed table are left out."""
    if allowed is not None:
        citations = citations.join(allowed, [id, "doc_id", "chunk_id"], "left_semi")
    first = citations.groupBy(id, "doc_id", "chunk_id").agg(F.min("start").alias("first"), F.count("*").alias("mentions"))
    return first.withColumn("index", F.row_number().over(Window.partitionBy(id).orderBy("first")))


def reconcile_citations(fed: DataFrame, cited: DataFrame, id: str = "message_id") -> DataFrame:
    """Every fed or cited pair as persisted, hallucinated or unused."""
    key = [id, "doc_id", "chunk_id"]
    a, b = fed.select(*key, F.lit(True).alias("fed")).distinct(), cited.select(*key, F.lit(True).alias("cited")).distinct()
    state = F.when(F.col("fed") & F.col("cited"), "persisted").when(F.col("cited"), "hallucinated").otherwise("unused")
    return a.join(b, key, "full_outer").select(*key, state.alias("state"))


def _tidy(c) -> Column:
    return trim_all(F.regexp_replace(collapse(strip_citations(c)), r" ([.,;:!?])", "$1"))


def citation_snippets(df: DataFrame, id: str = "message_id", text: str = "content", back: int = 4) -> DataFrame:
    """(id, doc_id, chunk_id, snippet): sentence of each marker, or the nearest of the ``back`` before it that has words."""
    sentences = F.split(F.col(text), r"(?<=[.!?])(?=\s)|(?<=\n)|(?=\n)")
    rows = df.select(id, F.posexplode(sentences).alias("n", "sentence"))
    clean = _tidy("sentence")
    line = Window.partitionBy(id).orderBy("n").rowsBetween(-back, 0)
    worded = rows.withColumn("clean", clean).withColumn("own", F.when(F.col("clean").rlike(r"[\p{L}\p{N}]"), F.col("clean")))
    found = worded.withColumn("snippet", F.coalesce(F.last("own", ignorenulls=True).over(line), "clean"))
    marks = found.select(id, "snippet", F.explode(F.regexp_extract_all("sentence", F.lit(f"({CITATION})"), F.lit(1))).alias("m"))
    number = lambda g: F.regexp_extract("m", CITATION, g).cast("long")
    return marks.select(id, number(1).alias("doc_id"), number(2).alias("chunk_id"), "snippet").filter(F.length("snippet") > 0).distinct()


def word_rows(df: DataFrame, id, text: str) -> DataFrame:
    """(id..., n, word, start, end) of words of two or more letters or digits."""
    ids = [id] if isinstance(id, str) else list(id)
    pattern = r"[\p{L}\p{N}]+"
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(F.col(text), pattern, -1)
    rows = df.select(*ids, F.posexplode(F.arrays_zip(gaps.alias("g"), found.alias("w"))).alias("k", "x"))
    line = Window.partitionBy(*ids).orderBy("k")
    upto = F.sum(F.length("x.g") + F.coalesce(F.length("x.w"), F.lit(0))).over(line).cast("int")
    placed = rows.withColumn("end", upto).filter(F.length("x.w") >= 2)
    return placed.select(*ids, (F.row_number().over(line) - 1).alias("n"), F.lower("x.w").alias("word"), (F.col("end") - F.length("x.w")).alias("start"), "end")


def overlap_spans(snippet: str, text: str) -> list[tuple[int, int]]:
    """Stretches of ``text`` that share the longest shingles they can with ``snippet``; see shingle_overlap()."""

    def shingles(words: list[str], size: int) -> list[str]:
        return [w if len(w) >= 5 else "" for w in words] if size == 1 else [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]

    wanted = [w.lower() for w in WORD.findall(snippet) if len(w) >= 2]
    found = [m for m in WORD.finditer(text) if m.end() - m.start() >= 2]
    words = [m[0].lower() for m in found]
    for size in (3, 2, 1):
        known = set(shingles(wanted, size)) - {""}
        hit = sorted({n for i, g in enumerate(shingles(words, size)) if g in known for n in range(i, i + size)})
        if hit:
            break
    spans, before = [], None
    for n in hit:
        start, end = found[n].span()
        if spans and (n == before + 1 or start - spans[-1][1] <= MERGE_GAP):
            spans[-1] = (spans[-1][0], end)
        else:
            spans.append((start, end))
        before = n
    return spans


def shingle_overlap(snippets: DataFrame, chunks: DataFrame) -> DataFrame:
    """Spans of each (snippet_id, chunk_id) pair's chunk that share word 3-grams with the snippet.

    2-grams, then single words of 5 letters, where longer shingles find nothing; spans at most 6
    characters apart are one.  ``snippets``: (snippet_id, chunk_id, snippet).  A pair's two texts meet in
    one row, so no word or shingle is dealt out.
    """

    def spans(batches):
        for batch in batches:
            rows = [overlap_spans(s, t) for s, t in zip(batch.column("snippet").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            at = pa.array([i for i, x in enumerate(rows) for _ in x], pa.int64())
            ends = (pa.array([x[k] for r in rows for x in r], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("snippet_id").take(at), batch.column("chunk_id").take(at), *ends], names=["snippet_id", "chunk_id", "start", "end"])

    long = lambda c: F.col(c).cast("long").alias(c)
    pairs = snippets.select(long("snippet_id"), long("chunk_id"), "snippet").join(chunks.select(long("chunk_id"), "text"), "chunk_id")
    return pairs.filter("snippet IS NOT NULL AND text IS NOT NULL").mapInArrow(spans, "snippet_id long, chunk_id long, start long, end long")


def literal_spans(df: DataFrame, id: str, text: str, needle: str) -> DataFrame:
    """(id, start, end) of all non-overlapping occurrences in any case."""
    want = F.lower(trim_all(needle))
    parts = F.split(F.lower(F.col(text)), F.concat(F.lit(r"\Q"), want, F.lit(r"\E")), -1)
    gaps = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), F.length)
    rows = df.withColumn("_row", F.monotonically_increasing_id()).filter(F.length(want) > 0).select(id, "_row", F.length(want).alias("n"), F.posexplode(gaps).alias("k", "gap"))
    end = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("_row").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(id, (end - F.col("n")).cast("long").alias("start"), end.cast("long").alias("end"))


def apply_spans(df: DataFrame, spans: DataFrame, id: str, text: str) -> DataFrame:
    """(id, start, part, highlighted): text cut at its spans; no part is empty."""
    length = df.select(id, F.col(text).alias("_t"), F.length(text).cast("long").alias("_n"))
    line = Window.partitionBy(id).orderBy("start")
    marked = spans.select(id, "start", "end").withColumn("_before", F.coalesce(F.lag("end").over(line), F.lit(0)).cast("long")).withColumn("_last", F.lead("start").over(line).isNull())
    pieces = marked.join(length, id).select(
        id, "_t",
        F.explode(F.array(
            F.struct(F.col("_before").alias("a"), F.col("start").alias("b"), F.lit(False).alias("h")),
            F.struct(F.col("start").alias("a"), F.col("end").alias("b"), F.lit(True).alias("h")),
            F.struct(F.col("end").alias("a"), F.when(F.col("_last"), F.col("_n")).otherwise(F.col("end")).alias("b"), F.lit(False).alias("h")),
        )).alias("x"),
    )
    plain = length.join(spans.select(id).distinct(), id, "left_anti").select(id, "_t", F.struct(F.lit(0).cast("long").alias("a"), F.col("_n").alias("b"), F.lit(False).alias("h")).alias("x"))
    every = pieces.unionByName(plain).filter("x.b > x.a")
    return every.select(id, F.col("x.a").alias("start"), F.col("_t").substr((F.col("x.a") + 1).cast("int"), (F.col("x.b") - F.col("x.a")).cast("int")).alias("part"), F.col("x.h").alias("highlighted"))


def resolve_target_document(queries: DataFrame, titles: DataFrame, least: float = 0.5, margin: float = 2.0, rare: int = RARE) -> DataFrame:
    """(query_id, kind, doc_id): resolved, ambiguous or none, by the share of title words in the query.

    Words of at most ``rare`` titles give a row for each pair of a query and a title, more frequent ones
    don't: titles with the same frequent words and as many words in all are alike to a query that has
    none of their rare words, so the two smallest ids stand for them, and queries with the same
    frequent words meet these once.
    """
    words = F.array_distinct(content_tokens(F.regexp_replace("title", r"(?i)\.[a-z]{1,8}$", "")))
    q = queries.select("query_id", F.array_distinct(F.filter(content_tokens("query"), lambda t: ~t.isin(*SUMMARY_WORDS))).alias("tokens"))
    t = titles.select("doc_id", words.alias("tokens"))
    each = lambda rows, id: rows.select(id, F.explode("tokens").alias("token"))
    frequent = written(each(t, "doc_id").groupBy("token").agg(F.count("*").alias("df")).filter(F.col("df") > rare).select("token"))

    def parted(rows: DataFrame, id: str) -> DataFrame:
        """(id, tokens, often): the frequent ones of a row's tokens, in order."""
        often = each(rows, id).join(frequent, "token").groupBy(id).agg(F.array_sort(F.collect_set("token")).alias("often"))
        return rows.join(often, id, "left").withColumn("often", F.coalesce("often", F.array().cast("array<string>")))

    q, t = written(parted(q, "query_id")), written(parted(t, "doc_id").withColumn("n", F.size("tokens")))
    seldom = F.explode(F.array_except("tokens", "often")).alias("token")
    met = q.select("query_id", F.col("often").alias("asked"), seldom).join(t.select("doc_id", "n", "often", seldom), "token")
    both = F.size(F.array_intersect(F.first("asked"), F.first("often")))
    near = met.groupBy("query_id", "doc_id").agg(((F.count("*") + both) / F.first("n")).alias("coverage"))

    # a title met by a rare word too is better than its like, so two of them are enough
    two = t.filter(F.size("often") > 0).withColumn("turn", F.row_number().over(Window.partitionBy("n", "often").orderBy("doc_id"))).filter("turn <= 2")
    alike = two.groupBy("n", "often").agg(F.collect_list("doc_id").alias("docs")).select("n", "docs", F.xxhash64("n", "often").alias("set"), F.explode("often").alias("token"))
    asked = q.filter(F.size("often") > 0).select(F.col("often").alias("asked")).distinct().select("asked", F.explode("asked").alias("token"))
    far = asked.join(alike, "token").groupBy("asked", "set", "n").agg((F.count("*") / F.first("n")).alias("coverage"), F.first("docs").alias("docs")).select("asked", "coverage", F.explode("docs").alias("doc_id"))
    best_two = far.withColumn("turn", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("coverage"), "doc_id"))).filter("turn <= 2").select(F.col("asked").alias("often"), "doc_id", "coverage")
    common = q.select("query_id", "often").join(best_two, "often").select("query_id", "doc_id", "coverage")

    cover = near.unionByName(common).groupBy("query_id", "doc_id").agg(F.max("coverage").alias("coverage"))
    line = Window.partitionBy("query_id").orderBy(F.desc("coverage"), "doc_id")
    best = cover.withColumn("turn", F.row_number().over(line)).withColumn("second", F.lead("coverage").over(line)).filter("turn = 1")
    kind = F.when(F.coalesce("coverage", F.lit(0.0)) < least, "none").when(F.col("coverage") < F.col("second") * margin, "ambiguous").otherwise("resolved")
    out = queries.select("query_id").join(best, "query_id", "left").withColumn("kind", kind)
    return out.select("query_id", "kind", F.when(F.col("kind") == "resolved", F.col("doc_id")).alias("doc_id"))


def route_queries(queries: DataFrame, titles: DataFrame) -> DataFrame:
    """(query_id, route, doc_id): retrieval, corpus_count, corpus_list or doc_summary.

    queries: query_id, query, focus (array of doc ids or null), pinned (doc id or null).
    """
    summary = queries.filter((F.size(split_questions("query")) == 1) & corpus_intent("query").isNull() & (query_breadth("query") == "summary"))
    focused = summary.filter(F.size("focus") > 0).select("query_id", F.explode("focus").alias("doc_id"))
    in_focus = titles.join(focused.select("doc_id").distinct(), "doc_id", "left_semi")
    free = resolve_target_document(summary.filter("coalesce(size(focus), 0) <= 0").select("query_id", "query"), titles)
    held = resolve_target_document(summary.filter("size(focus) > 0").select("query_id", "query"), in_focus)
    held = held.join(focused.withColumn("_ok", F.lit(True)), ["query_id", "doc_id"], "left").withColumn("kind", F.when((F.col("kind") == "resolved") & F.col("_ok").isNull(), "none").otherwise(F.col("kind"))).drop("_ok")
    found = free.unionByName(held.select("query_id", "kind", "doc_id")).select("query_id", F.col("kind").alias("target"), F.col("doc_id").alias("target_id"))
    many = F.size(split_questions("query")) > 1
    intent = corpus_intent("query")
    no_focus = F.coalesce(F.size("focus"), F.lit(0)) <= 0
    document = (
        F.when(many | intent.isNotNull() | (query_breadth("query") != "summary"), F.lit(None))
        .when(F.size("focus") == 1, F.get("focus", F.lit(0)))
        .when(F.col("target") == "resolved", F.col("target_id"))
        .when((F.coalesce("target", F.lit("none")) == "none") & (no_focus | F.array_contains("focus", F.col("pinned"))), F.col("pinned"))
    )
    route = F.when(many, "retrieval").when(intent == "count", "corpus_count").when(intent == "list", "corpus_list").when(document.isNotNull(), "doc_summary").otherwise("retrieval")
    return queries.join(found, "query_id", "left").select("query_id", route.alias("route"), document.alias("doc_id"))


def deck_language(decks: DataFrame, docs: DataFrame, chunks: DataFrame, looks_german, most: int = 600) -> DataFrame:
    """Language of the first selected document that has text: (deck_id, language)."""
    first = chunks.groupBy("doc_id").agg(F.min_by("text", "ordinal").alias("first"))
    sample = F.substring(F.concat_ws(" ", "title", F.coalesce("first", F.lit(""))), 1, most)
    texts = docs.select("doc_id", "title").join(first, "doc_id", "left").select("doc_id", looks_german(sample).alias("lang"))
    picked = decks.select("deck_id", F.posexplode("document_ids").alias("n", "doc_id")).join(texts, "doc_id").filter("lang = 'de'")
    german = picked.groupBy("deck_id").agg(F.min_by("lang", "n").alias("lang"))
    return decks.select("deck_id").join(german, "deck_id", "left").select("deck_id", F.coalesce("lang", F.lit("en")).alias("language"))


def expand_variants_filter(df: DataFrame, id: str = "query_id", query: str = "query", raw: str = "raw", most: int = 2) -> DataFrame:
    """(id, turn, variant): generated lines without bullets, of 4 to 239 characters, new and distinct, at most two."""
    key = lambda c: F.lower(collapse(c))
    lines = df.select(id, key(query).alias("own"), F.posexplode(F.split(raw, r"\r?\n")).alias("n", "line")).withColumn("variant", trim_all(F.regexp_replace("line", r"^[-*\d.\s]+", ""))).filter(F.length("variant").between(4, 239))
    fresh = lines.withColumn("key", key("variant")).filter("key <> own")
    first = fresh.withColumn("k", F.row_number().over(Window.partitionBy(id, "key").orderBy("n"))).filter("k = 1")
    return first.withColumn("turn", F.row_number().over(Window.partitionBy(id).orderBy("n"))).filter(F.col("turn") <= most).select(id, "turn", "variant")


def history_window(messages: DataFrame, turns: int = 6, chars: int = 600, cap: int = 1500) -> DataFrame:
    """Last turns of each conversation as text, and the token estimate of all its turns."""
    last = Window.partitionBy("conv_id").orderBy(F.desc("created_at"), F.desc("message_id"))
    recent = messages.withColumn("back", F.row_number().over(last)).filter(F.col("back") <= turns)
    short = F.when(F.length("content") > chars, F.concat(F.substring("content", 1, chars), F.lit("…"))).otherwise(F.col("content"))
    line = F.concat(F.when(F.col("role") == "user", "User").otherwise("Assistant"), F.lit(": "), short)
    text = recent.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("o"), line.alias("l")))), lambda x: x.l), "\n").alias("history"))
    cost = messages.groupBy("conv_id").agg(F.ceil(F.sum(F.least(F.length("content"), F.lit(cap)) + 12) / 3.5).cast("long").alias("tokens"))
    return text.join(cost, "conv_id")
