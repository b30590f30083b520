"""Keeping corpus tables in step with files and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import model_stem

KEY = ["workspace_id", "source_path"]


def under_watched_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows whose path is a watched root of their workspace or lies below one, in any case.

    The path's own ancestors are looked up, so this is an equi-join whatever the number of roots.
    """
    parts = F.split(F.lower("source_path"), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    tagged = files.withColumn("_row", F.struct(*KEY)).select("_row", "workspace_id", F.explode(ancestors).alias("root"))
    below = tagged.join(roots.select("workspace_id", F.lower(F.regexp_replace("path", "/$", "")).alias("root")).distinct(), ["workspace_id", "root"], "left_semi").select("_row.*").distinct()
    return files.join(below, KEY, "left_semi")


def reconcile_inventory(inventory: DataFrame, documents: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Action for every file and document: (workspace_id, source_path, action, touch).

    inventory: KEY, mtime, content_hash; documents: KEY, mtime, content_hash, missing_at.
    """
    watched = documents if roots is None else under_watched_root(documents, roots)
    d = documents.select(*KEY, F.col("mtime").alias("d_mtime"), F.col("content_hash").alias("d_hash"), "missing_at", F.lit(True).alias("known"))
    d = d.join(watched.select(*KEY, F.lit(True).alias("watched")).distinct(), KEY, "left")
    f = inventory.select(*KEY, F.col("mtime").alias("f_mtime"), F.col("content_hash").alias("f_hash"), F.lit(True).alias("seen"))
    action = (
        F.when(F.col("known").isNull(), "imported")
        .when(F.col("seen").isNull() & F.col("watched").isNull(), "untouched")
        .when(F.col("seen").isNull() & F.col("missing_at").isNotNull(), "still_missing")
        .when(F.col("seen").isNull(), "marked_missing")
        .when(F.col("d_hash").eqNullSafe(F.col("f_hash")), "unchanged")
        .otherwise("reindexed")
    )
    touch = F.coalesce((action == "unchanged") & ~F.col("d_mtime").eqNullSafe(F.col("f_mtime")), F.lit(False))
    return d.join(f, KEY, "full_outer").select(*KEY, action.alias("action"), touch.alias("touch"))


def mark_missing(documents: DataFrame, gone: DataFrame, now: int) -> DataFrame:
    """Sets missing_at where it isn't set yet."""
    hit = gone.select("doc_id", F.lit(True).alias("_gone")).distinct()
    return documents.join(hit, "doc_id", "left").withColumn("missing_at", F.when(F.col("_gone"), F.coalesce("missing_at", F.lit(now).cast("long"))).otherwise(F.col("missing_at"))).drop("_gone")


def clear_missing(documents: DataFrame, back: DataFrame) -> DataFrame:
    hit = back.select("doc_id", F.lit(True).alias("_back")).distinct()
    null = F.lit(None).cast("long")
    out = documents.join(hit, "doc_id", "left")
    for c in ("missing_at", "missing_dismissed_at"):
        out = out.withColumn(c, F.when(F.col("_back"), null).otherwise(F.col(c)))
    return out.drop("_back")


def dismiss_missing(documents: DataFrame, seen: DataFrame, now: int) -> DataFrame:
    hit = seen.select("doc_id", F.lit(True).alias("_seen")).distinct()
    return documents.join(hit, "doc_id", "left").withColumn("missing_dismissed_at", F.when(F.col("_seen"), F.lit(now).cast("long")).otherwise(F.col("missing_dismissed_at"))).drop("_seen")


def missing_unacknowledged(documents: DataFrame) -> DataFrame:
    """Missing documents not dismissed since, newest first."""
    open_ = F.col("missing_at").isNotNull() & (F.col("missing_dismissed_at").isNull() | (F.col("missing_dismissed_at") < F.col("missing_at")))
    return documents.filter(open_).orderBy(F.desc("missing_at"), "doc_id")


def dedup_by_path(documents: DataFrame) -> DataFrame:
    """The smallest id of every path; rows without a path all stay."""
    keep = documents.filter("source_path IS NOT NULL").groupBy(*KEY).agg(F.min("doc_id").alias("doc_id"))
    return documents.join(keep.select("doc_id"), "doc_id", "left_semi").unionByName(documents.filter("source_path IS NULL"))


def reset_documents(documents: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) with the given documents emptied for a new indexing."""
    hit = ids.select("doc_id", F.lit(True).alias("_reset")).distinct()
    out = documents.join(hit, "doc_id", "left")
    blank = {"chunk_count": F.lit(0).cast("long"), "token_count": F.lit(0).cast("long"), "status": F.lit("pending"), "summary": F.lit(None).cast("string"), "summary_embedding": F.lit(None), "summary_embedder_identity": F.lit(None).cast("string")}
    for c, v in blank.items():
        if c in documents.columns:
            out = out.withColumn(c, F.when(F.col("_reset"), v).otherwise(F.col(c)))
    return out.drop("_reset"), chunks.join(ids, "doc_id", "left_anti")


def reset_stuck(documents: DataFrame) -> DataFrame:
    return documents.withColumn("status", F.when(F.col("status").isin("indexing", "pending"), "failed").otherwise(F.col("status")))


def reset_stuck_decks(decks: DataFrame, message: str = "interrupted") -> DataFrame:
    stuck = F.col("status") == "generating"
    return decks.withColumn("error", F.when(stuck, message).otherwise(F.col("error"))).withColumn("status", F.when(stuck, "failed").otherwise(F.col("status")))


def chunk_counters(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.sum(F.coalesce("token_count", F.lit(0))).cast("long").alias("token_sum"))


def apply_counter_deltas(counters: DataFrame, inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """Counters after signed changes, never below zero."""
    delta = lambda df, sign: df.select("doc_id", F.lit(sign).cast("long").alias("c"), (sign * F.coalesce("token_count", F.lit(0))).cast("long").alias("t"))
    every = counters.select("doc_id", F.col("chunk_count").alias("c"), F.col("token_sum").alias("t")).unionByName(delta(inserted, 1)).unionByName(delta(deleted, -1))
    zero = F.lit(0).cast("long")
    return every.groupBy("doc_id").agg(F.greatest(F.sum("c"), zero).alias("chunk_count"), F.greatest(F.sum("t"), zero).alias("token_sum"))


def cascade_delete(documents: DataFrame, chunks: DataFrame, citations: DataFrame, tags: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    gone = chunks.join(ids, "doc_id", "left_semi").select("chunk_id")
    return documents.join(ids, "doc_id", "left_anti"), chunks.join(ids, "doc_id", "left_anti"), citations.join(gone, "chunk_id", "left_anti"), tags.join(ids, "doc_id", "left_anti")


def pending_embeddings(chunks: DataFrame, page: int | None = None, after: int | None = None) -> DataFrame:
    """Chunks without a vector in order of id; a page starts after an id."""
    out = chunks.filter("embedding IS NULL")
    if after is not None:
        out = out.filter(F.col("chunk_id") > after)
    return out.orderBy("chunk_id") if page is None else out.orderBy("chunk_id").limit(page)


def purge_incompatible_vectors(rows: DataFrame, active: str, clear_identity: bool = False) -> DataFrame:
    """Nulls vectors of another model than ``active``.

    ``clear_identity`` also nulls the identity: so it is for summaries, not for chunks.
    """
    other = F.coalesce(model_stem("embedder_identity") != model_stem(F.lit(active)), F.lit(False))
    out = rows.withColumn("embedding", F.when(~other, F.col("embedding")))
    return out.withColumn("embedder_identity", F.when(~other, F.col("embedder_identity"))) if clear_identity else out


def attach_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors by (doc_id, ordinal); chunks whose page failed stay null."""
    return chunks.drop("embedding").join(vectors.select("doc_id", "ordinal", "embedding"), ["doc_id", "ordinal"], "left")


def embedding_progress(chunks: DataFrame) -> DataFrame:
    done = F.count_if(F.col("embedding").isNotNull())
    return chunks.groupBy("workspace_id").agg(done.alias("done"), F.count("*").alias("total"), (F.count("*") - done).alias("missing"))


def set_summary(documents: DataFrame, updates: DataFrame) -> DataFrame:
    """A new summary (doc_id, summary) clears the old vector and its identity."""
    u = updates.select("doc_id", F.col("summary").alias("_new"), F.lit(True).alias("_set"))
    out = documents.join(u, "doc_id", "left").withColumn("summary", F.when(F.col("_set"), F.col("_new")).otherwise(F.col("summary")))
    for c in ("summary_embedding", "summary_embedder_identity"):
        out = out.withColumn(c, F.when(F.col("_set").isNull(), F.col(c)))
    return out.drop("_new", "_set")


def set_summary_vectors(documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """New summary vectors (doc_id, embedding, identity); summaries stay."""
    v = vectors.select("doc_id", F.col("embedding").alias("_v"), F.col("identity").alias("_i"), F.lit(True).alias("_set"))
    out = documents.join(v, "doc_id", "left")
    return out.withColumn("summary_embedding", F.when(F.col("_set"), F.col("_v")).otherwise(F.col("summary_embedding"))).withColumn("summary_embedder_identity", F.when(F.col("_set"), F.col("_i")).otherwise(F.col("summary_embedder_identity"))).drop("_v", "_i", "_set")


def replace_folder_set(folders: DataFrame, new: DataFrame, workspaces: DataFrame) -> DataFrame:
    """The given workspaces have exactly the new folders."""
    return folders.join(workspaces, "workspace_id", "left_anti").unionByName(new.join(workspaces, "workspace_id", "left_semi")).dropDuplicates(["workspace_id", "path"]).orderBy("workspace_id", "path")


def explode_folder_arrays(workspaces: DataFrame) -> DataFrame:
    return workspaces.select("workspace_id", F.explode("folders").alias("path")).filter("path IS NOT NULL").distinct()


def upsert_rows(rows: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Updates by key: non-null fields replace, unknown keys are added."""
    u = updates.select(key, *(F.col(c).alias(f"_u_{c}") for c in updates.columns if c != key))
    joined = rows.join(u, key, "full_outer")
    value = lambda c: F.coalesce(f"_u_{c}", c) if f"_u_{c}" in u.columns else F.col(c)
    return joined.select(*(F.col(c) if c == key else value(c).alias(c) for c in rows.columns))


def append_messages(messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages with the valid new ones, rows rejected for their role)."""
    good = F.col("role").isin("user", "assistant", "system")
    return messages.unionByName(new.filter(good)), new.filter(~F.coalesce(good, F.lit(False)))
