"""Fusing, weighting, diversifying and packing ranked results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_tokens, estimate_tokens, hit_header
from ..sources.shared import written
from .lexical import search_chunks, top_per_group
from .vectors import knn_among, knn_exact

RRF_K = 60
SMALL_DOCUMENT = 8
SEPARATOR = "\n\n---\n\n"
HISTORY_MOST = 1500


def rrf_fuse(lists: list[DataFrame], cap: int, k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over ranked lists (query_id, chunk_id, rank); ties by first appearance."""
    tagged = [d.select("query_id", "chunk_id", "rank", F.lit(i).alias("list")) for i, d in enumerate(lists)]
    every = reduce(DataFrame.unionByName, tagged)
    fused = every.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    return top_per_group(fused, ["query_id"], [F.desc(F.round("score", 12)), "seen", "chunk_id"], cap).select("query_id", "rank", "chunk_id", "score")


def rrf_fuse_variants(lists: list[DataFrame], cap: int, k: int = RRF_K) -> DataFrame:
    """Lists fused one after the other, cut to ``cap`` after each (at most ten lists)."""
    if len(lists) > 10:
        raise ValueError("at most five variants of two lists")
    out = lists[0]
    for d in lists[1:]:
        out = rrf_fuse([out, d], cap, k)
    return out


def candidate_k(k, small: bool = False) -> Column:
    most, times = (32, 2) if small else (64, 4)
    k = F.lit(k) if isinstance(k, int) else k
    return F.least(F.lit(most), F.greatest(k * times, k))


def _on(factor: float) -> bool:
    return factor > 0 and factor != 1.0


def boost_title(title, query, factor: float = 1.25) -> Column:
    return F.when(F.arrays_overlap(content_tokens(title), content_tokens(query)), factor).otherwise(1.0) if _on(factor) else F.lit(1.0)


def penalise_short(text, factor: float = 0.7, least: int = 200) -> Column:
    return F.when(F.length(text) < least, factor).otherwise(1.0) if _on(factor) else F.lit(1.0)


def boost_recent(added_at, now: int, factor: float = 1.1, window: int = 600) -> Column:
    return F.when(F.lit(now) - F.col(added_at) <= window, factor).otherwise(1.0) if _on(factor) and window > 0 else F.lit(1.0)


def boost_language(language, answer: str | None, factor: float = 1.1) -> Column:
    return F.when((F.col(language) == answer) & (F.col(language) != "other"), factor).otherwise(1.0) if _on(factor) and answer else F.lit(1.0)


def apply_heuristics(hits: DataFrame, now: int, answer: str | None = None, title: float = 1.25, short: float = 0.7, recent: float = 1.1, language: float = 1.1) -> DataFrame:
    """Multiplies the score by every factor, then ranks anew."""
    factor = boost_title("title", "query", title) * penalise_short("text", short) * boost_recent("added_at", now, recent) * boost_language("language", answer, language)
    scored = hits.withColumn("score", F.col("score") * factor)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "rank", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order))


def rerank_with_scores(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """Ranks by supplied scores (query_id, chunk_id, pair_score); a query with missing scores keeps its order."""
    of = Window.partitionBy("query_id")
    joined = hits.join(scores, ["query_id", "chunk_id"], "left").withColumn("_all", F.count("pair_score").over(of) == F.count("*").over(of))
    score = F.when(F.col("_all"), F.col("pair_score")).otherwise(F.col("score"))
    ranked = joined.withColumn("score", score)
    order = of.orderBy(F.when(F.col("_all"), -F.col("score")).otherwise(F.col("rank").cast("double")), "rank")
    return ranked.withColumn("rank", F.row_number().over(order)).drop("_all", "pair_score")


def diversify_by_document(hits: DataFrame, k: int) -> DataFrame:
    """Round robin over documents in order of first appearance; queries with at most k hits stay as they are."""
    of = Window.partitionBy("query_id")
    doc = Window.partitionBy("query_id", "doc_id")
    ranked = hits.withColumn("_n", F.count("*").over(of)).withColumn("_turn", F.row_number().over(doc.orderBy("rank"))).withColumn("_first", F.min("rank").over(doc))
    key = F.when(F.col("_n") <= k, F.struct(F.lit(0).alias("a"), F.col("rank").alias("b"))).otherwise(F.struct(F.col("_turn").alias("a"), F.col("_first").alias("b")))
    return ranked.withColumn("rank", F.row_number().over(of.orderBy(key))).filter(F.col("rank") <= k).drop("_n", "_turn", "_first")


def _new(found: DataFrame, hits: DataFrame, origin: str) -> DataFrame:
    fresh = found.join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return fresh.select("query_id", "chunk_id", "doc_id", "ordinal", F.lit(0.0).alias("score"), F.lit(origin).alias("origin"))


def expand_small_documents(hits: DataFrame, chunks: DataFrame, most: int = SMALL_DOCUMENT) -> DataFrame:
    """All other chunks of hit documents with at most ``most`` chunks."""
    small = chunks.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") <= most)
    of = hits.select("query_id", "doc_id").distinct().join(small.select("doc_id"), "doc_id")
    return _new(of.join(chunks.select("doc_id", "chunk_id", "ordinal"), "doc_id"), hits, "whole_doc")


def expand_neighbours(hits: DataFrame, chunks: DataFrame, radius: int = 1) -> DataFrame:
    """Chunks within ``radius`` ordinals of a hit, as an equi-join on the places around it."""
    around = F.explode(F.sequence(F.col("ordinal") - radius, F.col("ordinal") + radius))
    near = hits.select("query_id", "doc_id", around.alias("ordinal")).distinct()
    return _new(near.join(chunks.select("doc_id", "chunk_id", "ordinal"), ["doc_id", "ordinal"]), hits, "neighbour")


def interleave_by_document(hits: DataFrame, additions: DataFrame) -> DataFrame:
    """Additions stand after the first hit of their document, in ordinal order."""
    first = hits.groupBy("query_id", "doc_id").agg(F.min("rank").alias("_base"))
    a = hits.select("query_id", "chunk_id", "doc_id", "ordinal", "score", F.lit("primary").alias("origin"), F.col("rank").alias("_base"), F.lit(0).alias("_added"))
    b = additions.join(first, ["query_id", "doc_id"]).select("query_id", "chunk_id", "doc_id", "ordinal", "score", "origin", "_base", F.lit(1).alias("_added"))
    order = Window.partitionBy("query_id").orderBy("_base", "_added", "ordinal", "chunk_id")
    return a.unionByName(b).withColumn("rank", F.row_number().over(order)).drop("_base", "_added")


def trim_to_char_budget(hits: DataFrame, budget: int, chars: str = "chars") -> DataFrame:
    """Drops from the back until the budget holds: neighbours, whole documents, then primaries, never all."""
    tier = F.when(F.col("origin") == "neighbour", 0).when(F.col("origin") == "whole_doc", 1).otherwise(2)
    of = Window.partitionBy("query_id")
    back = of.orderBy("_tier", F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    marked = hits.withColumn("_tier", tier).withColumn("_over", F.sum(chars).over(of) - budget).withColumn("_gone", F.coalesce(F.sum(chars).over(back), F.lit(0))).withColumn("_left", F.count("*").over(of) - F.coalesce(F.count("*").over(back), F.lit(0)))
    return marked.filter((F.col("_gone") >= F.col("_over")) | (F.col("_left") <= 1)).drop("_tier", "_over", "_gone", "_left")


def pack_to_token_budget(hits: DataFrame, budget, by=("query_id",), header: Column | None = None) -> DataFrame:
    """Longest prefix by rank whose header, text and separator fit; the first hit always stays."""
    head = header if header is not None else hit_header("doc_id", "chunk_id", "title")
    upto = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cost = estimate_tokens(head) + estimate_tokens("text") + 4
    placed = hits.withColumn("cost", cost).withColumn("used", F.sum("cost").over(upto)).withColumn("_turn", F.row_number().over(Window.partitionBy(*by).orderBy("rank")))
    return placed.filter((F.col("_turn") == 1) | (F.col("used") <= budget)).drop("_turn")


def pinned_budget(total: int, pinned: int) -> int:
    return 0 if pinned == 0 or total <= 0 else min(int(total * 0.4), 4096)


def pinned_share(pinned: DataFrame, hits: DataFrame, total: int) -> DataFrame:
    """Pinned documents' first chunks ahead of the hits, sharing the budget.

    ``pinned``: (query_id, doc_id, chunk_id, ordinal, title, text).  Adds ``section`` (0 pinned, 1 hits).
    """
    n = pinned.groupBy("query_id").agg(F.count_distinct("doc_id").alias("n"))
    share = F.least(F.floor(F.lit(total * 0.4)), F.lit(4096))
    per_doc = F.greatest(F.lit(1), F.floor(share / F.col("n")))
    a = pack_to_token_budget(pinned.withColumn("rank", F.col("ordinal")).join(n, "query_id").withColumn("_budget", per_doc), F.col("_budget"), ("query_id", "doc_id")).withColumn("section", F.lit(0))
    rest = hits.join(n, "query_id", "left").withColumn("_budget", F.lit(total) - F.when(F.col("n") > 0, share).otherwise(0))
    b = pack_to_token_budget(rest, F.col("_budget")).withColumn("section", F.lit(1))
    columns = ["query_id", "section", "doc_id", "chunk_id", "rank", "cost"]
    return a.select(columns).unionByName(b.select(columns))


def below_threshold(queries: DataFrame, hits: DataFrame, least: float) -> DataFrame:
    """Queries whose best score is too low or that have no hit, with up to three other documents to suggest."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    refused = queries.select("query_id").join(best, "query_id", "left").filter(F.col("best").isNull() | (F.col("best") < least))
    per_doc = hits.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    three = top_per_group(per_doc, ["query_id"], ["rank", "doc_id"], 3, "turn")
    listed = three.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "doc_id"))), lambda x: x.doc_id).alias("suggested"))
    return refused.join(listed, "query_id", "left").select("query_id", "best", F.coalesce("suggested", F.array().cast("array<bigint>")).alias("suggested"))


def context_block(hits: DataFrame, header: Column | None = None) -> DataFrame:
    """Per query: headers and texts in order of section and rank, with a rule between."""
    head = header if header is not None else hit_header("doc_id", "chunk_id", "title")
    section = F.col("section") if "section" in hits.columns else F.lit(1)
    rows = hits.select("query_id", F.struct(section.alias("s"), "rank", F.concat(head, F.lit("\n"), F.col("text")).alias("t")).alias("x"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x.t), SEPARATOR).alias("context"))


def hybrid_search(
    queries: DataFrame,
    chunks: DataFrame,
    docs: DataFrame,
    vectors: DataFrame,
    query_vectors: DataFrame,
    now: int,
    k: int = 8,
    summaries: DataFrame | None = None,
    documents: int = 5,
    least: float = 0.2,
    pair_scores: DataFrame | None = None,
    answer: str | None = None,
    cap: int = 3,
    radius: int = 1,
) -> DataFrame:
    """The whole search: (query_id, rank, chunk_id, doc_id, score, origin).

    ``summaries`` (doc_id, embedding) narrow each query to its ``documents`` nearest ready documents of
    at least ``least`` similarity; a query without any is not narrowed.  Chunks found by words
    (BM25) and by ``vectors`` (chunk_id, doc_id, embedding) are fused, weighted, reranked by
    ``pair_scores`` (query_id, chunk_id, pair_score) where given, and dealt out over documents.  The
    other chunks of small documents and the neighbours of the hits follow the first hit of their document.
    """
    ready = docs.filter(F.col("status") == "ready")
    vectors = vectors.join(ready.select("doc_id"), "doc_id", "left_semi")
    candidates = min(64, max(k * 4, k))
    allowed = None
    if summaries is not None:
        own = summaries.join(ready.select("doc_id"), "doc_id", "left_semi")
        allowed = knn_exact(query_vectors, own, documents, "doc_id", least=least).select("query_id", "doc_id")
        allowed = written(allowed)
    lexical = search_chunks(queries, chunks, docs, candidates, cap, allowed=allowed)
    dense = knn_among(query_vectors, vectors, allowed, candidates, cap, "chunk_id")
    # each part is asked for several times below: computed once, at most a few rows a query
    fused = written(rrf_fuse([lexical, dense], candidates))
    meta = chunks.select("chunk_id", "doc_id", "ordinal", "text", "language").join(docs.select("doc_id", "title", "added_at"), "doc_id")
    weighed = apply_heuristics(fused.join(meta, "chunk_id").join(queries, "query_id"), now, answer)
    if pair_scores is not None:
        weighed = rerank_with_scores(weighed, pair_scores)
    hits = written(diversify_by_document(weighed.select("query_id", "rank", "chunk_id", "doc_id", "ordinal", "score"), k))
    whole = expand_small_documents(hits, chunks)
    whole = written(whole)
    near = expand_neighbours(hits, chunks, radius).join(whole.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return interleave_by_document(hits, whole.unionByName(near)).select("query_id", "rank", "chunk_id", "doc_id", "score", "origin")
