"""Queries over sources, maintenance, chunking and filters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking as C
from ..operators import maintenance as B
from ..operators import models as U
from ..operators import relational as K
from ..sources import files as A
from .views import NOW, chunks, docs, queries, query, scratch, table


@query("scan_tables", "SELECT doc_id, title, workspace_id, byte_size, added_at, status FROM docs", "docs")
def scan_tables(spark, d):
    return docs(spark, d).select("doc_id", "title", "workspace_id", "byte_size", "added_at", "status")


@query("write_chunks", "SELECT chunk_id, doc_id, ordinal, replace(text, chr(0), '') AS text FROM chunks", "chunks")
def write_chunks(spark, d):
    """Half of the documents' chunks are stored, then all, then all again: each is there once."""
    path = scratch(spark)
    rows = chunks(spark, d).join(docs(spark, d).select("doc_id", "workspace_id"), "doc_id")
    for part in (rows.filter("doc_id % 2 = 0"), rows, rows):
        A.write_chunks(part, path)
    return A.stored_chunks(spark, path).select("chunk_id", "doc_id", "ordinal", "text")


@query("document_text", "SELECT doc_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY ordinal)) AS text_md5 FROM chunks GROUP BY doc_id", "chunks")
def document_text(spark, d):
    return A.document_text(chunks(spark, d)).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("dataset_fingerprint")
def dataset_fingerprint(spark, d):
    return A.dataset_fingerprint(chunks(spark, d))


def _known(spark, d):
    x = docs(spark, d).filter("doc_id % 7 <> 0")
    path = F.concat(F.lit("/lib/"), F.col("source"), F.lit("/"), "title")
    null = F.lit(None).cast("long")
    return x.select("doc_id", "workspace_id", path.alias("source_path"), F.col("added_at").alias("mtime"), (F.col("byte_size") * 31).cast("string").alias("content_hash"), F.when(F.col("doc_id") % 11 == 0, F.col("added_at") + 5).alias("missing_at"), F.when(F.col("doc_id") % 22 == 0, F.col("added_at") + F.when(F.col("doc_id") % 44 == 0, 9).otherwise(1)).otherwise(null).alias("missing_dismissed_at"))


def _inventory(spark, d):
    x = docs(spark, d).filter("doc_id % 5 <> 0")
    path = F.concat(F.lit("/lib/"), F.col("source"), F.lit("/"), "title")
    return x.select("workspace_id", path.alias("source_path"), (F.col("added_at") + F.when(F.col("doc_id") % 3 == 0, 60).otherwise(0)).alias("mtime"), (F.col("byte_size") * F.when(F.col("doc_id") % 6 == 0, 37).otherwise(31)).cast("string").alias("content_hash"))


def _roots(spark, d):
    return docs(spark, d).filter("source <> 'src3'").select("workspace_id", F.concat(F.lit("/LIB/"), F.col("source")).alias("path")).distinct()


KNOWN = "SELECT doc_id, workspace_id, '/lib/' || source || '/' || title AS source_path, source, added_at AS mtime, (byte_size * 31)::VARCHAR AS content_hash, CASE WHEN doc_id % 11 = 0 THEN added_at + 5 END AS missing_at, CASE WHEN doc_id % 22 = 0 THEN added_at + CASE WHEN doc_id % 44 = 0 THEN 9 ELSE 1 END END AS missing_dismissed_at FROM docs WHERE doc_id % 7 <> 0"
RECONCILE = f"""WITH k AS ({KNOWN}),
i AS (SELECT workspace_id, '/lib/' || source || '/' || title AS source_path, added_at + CASE WHEN doc_id % 3 = 0 THEN 60 ELSE 0 END AS mtime, (byte_size * CASE WHEN doc_id % 6 = 0 THEN 37 ELSE 31 END)::VARCHAR AS content_hash, true AS seen FROM docs WHERE doc_id % 5 <> 0),
j AS (SELECT coalesce(k.workspace_id, i.workspace_id) AS workspace_id, coalesce(k.source_path, i.source_path) AS source_path,
  CASE WHEN k.doc_id IS NULL THEN 'imported' WHEN i.seen IS NULL AND k.source = 'src3' THEN 'untouched' WHEN i.seen IS NULL AND k.missing_at IS NOT NULL THEN 'still_missing' WHEN i.seen IS NULL THEN 'marked_missing' WHEN k.content_hash = i.content_hash THEN 'unchanged' ELSE 'reindexed' END AS action,
  k.mtime AS km, i.mtime AS im FROM k FULL JOIN i ON k.workspace_id = i.workspace_id AND k.source_path = i.source_path)"""


@query("reconcile_inventory", RECONCILE + " SELECT workspace_id, source_path, action, action = 'unchanged' AND km <> im AS touch FROM j", "docs")
def reconcile_inventory(spark, d):
    return B.reconcile_inventory(_inventory(spark, d), _known(spark, d), _roots(spark, d))


@query("reconcile_summary", RECONCILE + " SELECT action, count(*) AS n FROM j GROUP BY action", "docs")
def reconcile_summary(spark, d):
    return reconcile_inventory(spark, d).groupBy("action").agg(F.count("*").alias("n"))


@query("under_watched_root", f"WITH k AS ({KNOWN}) SELECT doc_id, source_path FROM k WHERE source <> 'src3'", "docs")
def under_watched_root(spark, d):
    return B.under_watched_root(_known(spark, d), _roots(spark, d)).select("doc_id", "source_path")


@query("mark_missing", f"WITH k AS ({KNOWN}) SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(missing_at, {NOW}) ELSE missing_at END AS missing_at FROM k", "docs")
def mark_missing(spark, d):
    known = _known(spark, d)
    return B.mark_missing(known, known.filter("doc_id % 2 = 0"), NOW).select("doc_id", "missing_at")


@query("clear_missing", f"WITH k AS ({KNOWN}) SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN missing_at END AS missing_at, CASE WHEN doc_id % 3 <> 0 THEN missing_dismissed_at END AS missing_dismissed_at FROM k", "docs")
def clear_missing(spark, d):
    known = _known(spark, d)
    return B.clear_missing(known, known.filter("doc_id % 3 = 0")).select("doc_id", "missing_at", "missing_dismissed_at")


@query("dismiss_missing", f"WITH k AS ({KNOWN}) SELECT doc_id, CASE WHEN missing_at IS NOT NULL THEN {NOW} ELSE missing_dismissed_at END AS missing_dismissed_at FROM k", "docs")
def dismiss_missing(spark, d):
    known = _known(spark, d)
    return B.dismiss_missing(known, known.filter("missing_at IS NOT NULL"), NOW).select("doc_id", "missing_dismissed_at")


@query("missing_unacknowledged", f"WITH k AS ({KNOWN}) SELECT doc_id, missing_at FROM k WHERE missing_at IS NOT NULL AND (missing_dismissed_at IS NULL OR missing_dismissed_at < missing_at)", "docs")
def missing_unacknowledged(spark, d):
    return B.missing_unacknowledged(_known(spark, d)).select("doc_id", "missing_at")


@query("dedup_by_path", "SELECT min(doc_id) AS doc_id, workspace_id, source AS source_path FROM docs GROUP BY workspace_id, source", "docs")
def dedup_by_path(spark, d):
    return B.dedup_by_path(docs(spark, d).withColumn("source_path", F.col("source"))).select("doc_id", "workspace_id", "source_path")


@query("reset_documents", "SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'pending' ELSE status END AS status, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE md5(text) END AS summary, CASE WHEN doc_id % 13 = 0 THEN 0 ELSE (SELECT count(*) FROM chunks c WHERE c.doc_id = docs.doc_id) END AS chunks_left FROM docs", "docs", "chunks")
def reset_documents(spark, d):
    x = docs(spark, d).withColumn("summary", F.md5(F.col("text").cast("binary")))
    out, left = B.reset_documents(x, chunks(spark, d), x.filter("doc_id % 13 = 0").select("doc_id"))
    n = left.groupBy("doc_id").agg(F.count("*").alias("n"))
    return out.join(n, "doc_id", "left").select("doc_id", "status", "summary", F.coalesce("n", F.lit(0)).alias("chunks_left"))


@query("reset_stuck", "SELECT doc_id, CASE WHEN status IN ('indexing', 'pending') THEN 'failed' ELSE status END AS status FROM docs", "docs")
def reset_stuck(spark, d):
    return B.reset_stuck(docs(spark, d)).select("doc_id", "status")


@query("chunk_counters", "SELECT doc_id, count(*) AS chunk_count, sum(token_count)::BIGINT AS token_sum FROM chunks GROUP BY doc_id", "chunks")
def chunk_counters(spark, d):
    return B.chunk_counters(chunks(spark, d))


@query("chunk_counter_deltas", "SELECT doc_id, greatest(sum(CASE WHEN ordinal % 5 = 0 THEN -1 WHEN ordinal % 3 = 0 THEN 1 ELSE 0 END) + count(*), 0)::BIGINT AS chunk_count, greatest(sum(CASE WHEN ordinal % 5 = 0 THEN -token_count WHEN ordinal % 3 = 0 THEN token_count ELSE 0 END) + sum(token_count), 0)::BIGINT AS token_sum FROM chunks GROUP BY doc_id", "chunks")
def chunk_counter_deltas(spark, d):
    c = chunks(spark, d)
    return B.apply_counter_deltas(B.chunk_counters(c), c.filter("ordinal % 3 = 0 AND ordinal % 5 <> 0"), c.filter("ordinal % 5 = 0"))


@query("cascade_delete", "SELECT (SELECT count(*) FROM docs WHERE doc_id % 9 <> 0) AS documents, (SELECT count(*) FROM chunks WHERE doc_id % 9 <> 0) AS chunks, (SELECT count(*) FROM chunks WHERE doc_id % 9 <> 0 AND ordinal % 4 = 0) AS citations, (SELECT count(*) FROM docs WHERE doc_id % 9 <> 0) AS tags", "docs", "chunks")
def cascade_delete(spark, d):
    x, c = docs(spark, d), chunks(spark, d)
    out = B.cascade_delete(x, c, c.filter("ordinal % 4 = 0").select("chunk_id"), x.select("doc_id", F.col("source").alias("tag")), x.filter("doc_id % 9 = 0").select("doc_id"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    a, b, c2, t = (one(df, n) for df, n in zip(out, ("documents", "chunks", "citations", "tags"), strict=True))
    return a.join(b).join(c2).join(t)


def _with_vectors(spark, d):
    c = chunks(spark, d).join(docs(spark, d).select("doc_id", "workspace_id"), "doc_id")
    vector = F.when(F.col("chunk_id") % 3 != 0, F.array(F.lit(1.0), F.col("ordinal").cast("double")))
    model = F.when(F.col("chunk_id") % 2 == 0, "ollama://lib/BGE-M3-GGUF:q8").otherwise("minilm")
    return c.withColumn("embedding", vector).withColumn("embedder_identity", model)


@query("pending_embeddings", "SELECT chunk_id FROM chunks WHERE chunk_id % 3 = 0 ORDER BY chunk_id", "chunks")
def pending_embeddings(spark, d):
    return B.pending_embeddings(_with_vectors(spark, d)).select("chunk_id")


@query("pending_embeddings_count", "SELECT count(*) AS n FROM chunks WHERE chunk_id % 3 = 0", "chunks")
def pending_embeddings_count(spark, d):
    return _with_vectors(spark, d).filter("embedding IS NULL").agg(F.count("*").alias("n"))


@query("model_stem", "SELECT s_suppkey, regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(m, '^[^:/]+://', ''), '^.*/', ''), ':.*$', '')), '-gguf$', '') AS stem FROM (SELECT s_suppkey, 'hub://org/' || replace(s_name, '#', '-') || CASE WHEN s_suppkey % 2 = 0 THEN '-GGUF' ELSE '' END || ':q4' AS m FROM supplier)")
def model_stem(spark, d):
    s = table(spark, d, "supplier")
    name = F.concat(F.lit("hub://org/"), F.replace("s_name", F.lit("#"), F.lit("-")), F.when(F.col("s_suppkey") % 2 == 0, "-GGUF").otherwise(""), F.lit(":q4"))
    return s.select("s_suppkey", X.model_stem(name).alias("stem"))


@query("purge_incompatible_vectors", "SELECT chunk_id, (chunk_id % 3 <> 0 AND chunk_id % 2 = 0) AS has_vector FROM chunks", "chunks")
def purge_incompatible_vectors(spark, d):
    return B.purge_incompatible_vectors(_with_vectors(spark, d), "bge-m3").select("chunk_id", F.col("embedding").isNotNull().alias("has_vector"))


@query("vector_identities", "SELECT DISTINCT CASE WHEN chunk_id % 2 = 0 THEN 'ollama://lib/BGE-M3-GGUF:q8' ELSE 'minilm' END AS embedder_identity FROM chunks", "chunks")
def vector_identities(spark, d):
    return _with_vectors(spark, d).select("embedder_identity").distinct()


@query("attach_vectors", "SELECT chunk_id, ordinal % 4 <> 0 AS attached FROM chunks", "chunks")
def attach_vectors(spark, d):
    c = chunks(spark, d)
    v = c.filter("ordinal % 4 <> 0").select("doc_id", "ordinal", F.array(F.lit(1.0)).alias("embedding"))
    return B.attach_vectors(c, v).select("chunk_id", F.col("embedding").isNotNull().alias("attached"))


@query("embedding_progress", "SELECT d.workspace_id, count(*) FILTER (c.chunk_id % 3 <> 0) AS done, count(*) AS total, count(*) FILTER (c.chunk_id % 3 = 0) AS missing FROM chunks c JOIN docs d USING (doc_id) GROUP BY 1", "docs", "chunks")
def embedding_progress(spark, d):
    return B.embedding_progress(_with_vectors(spark, d))


@query("set_summary", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new ' || doc_id ELSE 'old' END AS summary, doc_id % 4 <> 0 AS has_vector, CASE WHEN doc_id % 4 <> 0 THEN 'm' END AS identity FROM docs", "docs")
def set_summary(spark, d):
    x = docs(spark, d).select("doc_id", F.lit("old").alias("summary"), F.array(F.lit(1.0)).alias("summary_embedding"), F.lit("m").alias("summary_embedder_identity"))
    new = x.filter("doc_id % 4 = 0").select("doc_id", F.concat(F.lit("new "), F.col("doc_id").cast("string")).alias("summary"))
    return B.set_summary(x, new).select("doc_id", "summary", F.col("summary_embedding").isNotNull().alias("has_vector"), F.col("summary_embedder_identity").alias("identity"))


@query("replace_folder_set", "SELECT DISTINCT workspace_id, CASE WHEN workspace_id = 1 THEN '/new/' ELSE '/lib/' END || source AS path FROM docs", "docs")
def replace_folder_set(spark, d):
    x = docs(spark, d)
    old = x.select("workspace_id", F.concat(F.lit("/lib/"), "source").alias("path"))
    new = x.select("workspace_id", F.concat(F.lit("/new/"), "source").alias("path"))
    return B.replace_folder_set(old, new, x.filter("workspace_id = 1").select("workspace_id").distinct())


@query("explode_folder_arrays", "SELECT DISTINCT workspace_id, source AS path FROM docs", "docs")
def explode_folder_arrays(spark, d):
    return B.explode_folder_arrays(docs(spark, d).groupBy("workspace_id").agg(F.collect_set("source").alias("folders")))


@query("upsert_rows", "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'renamed' ELSE title END AS title, CASE WHEN doc_id % 6 = 0 AND doc_id % 12 = 0 THEN 'failed' ELSE status END AS status FROM docs", "docs")
def upsert_rows(spark, d):
    x = docs(spark, d).select("doc_id", "title", "status")
    new = x.filter("doc_id % 6 = 0").select("doc_id", F.lit("renamed").alias("title"), F.when(F.col("doc_id") % 12 == 0, "failed").alias("status"))
    return B.upsert_rows(x, new, "doc_id")


# Chunking


@query("chunk_fixed", "SELECT chunk_id, doc_id, ordinal, length(text) AS n_chars, md5(text) AS text_md5 FROM chunks", "chunks")
def chunk_fixed(spark, d):
    return chunks(spark, d).select("chunk_id", "doc_id", "ordinal", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("chunk_recursive")
def chunk_recursive(spark, d):
    return C.chunk_recursive(docs(spark, d))


@query("split_markdown_sections")
def split_markdown_sections(spark, d):
    return C.split_markdown_sections(docs(spark, d).withColumn("text", F.regexp_replace("text", r"(?m)^(\S+ \S+ \S+) ", "# $1\n")))


@query("chunk_markdown")
def chunk_markdown(spark, d):
    return C.chunk_markdown(docs(spark, d).withColumn("text", F.regexp_replace("text", r"(?m)^(\S+ \S+ \S+) ", "# $1\n")))


def _pages(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text")).select("doc_id", (F.col("p") + 1).cast("long").alias("page"), "text")


@query("chunk_pages")
def chunk_pages(spark, d):
    return C.chunk_pages(_pages(spark, d))


@query("merge_overlap")
def merge_overlap(spark, d):
    return C.chunk_recursive(docs(spark, d), most=400, overlap=50)


@query("tag_sections_asof", "SELECT c.chunk_id, (SELECT arg_max(s.chunk_id, s.ordinal) FROM chunks s WHERE s.doc_id = c.doc_id AND s.ordinal % 5 = 2 AND s.ordinal <= c.ordinal) AS section_id FROM chunks c", "chunks")
def tag_sections_asof(spark, d):
    c = chunks(spark, d).withColumn("page_from", F.col("ordinal"))
    s = c.filter("ordinal % 5 = 2").select("doc_id", F.col("ordinal").alias("page_start"), F.array(F.col("chunk_id").cast("string")).alias("path"), F.lit(0).alias("seq"))
    return C.tag_sections_asof(c, s).select("chunk_id", F.get("heading_path", F.lit(0)).cast("long").alias("section_id"))


@query("clean_page_text", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(t, ', ', ' .....  '), '(?:[ \t]*\.){4,}[ \t]*', ' ', 'g'), '_{4,}', ' ', 'g'), '-{4,}', ' ', 'g'), '[ \t]{2,}', ' ', 'g'), '[ \t]+\n', chr(10), 'g') AS cleaned FROM (SELECT doc_id, text AS t FROM docs)", "docs")
def clean_page_text(spark, d):
    raw = F.replace("text", F.lit(", "), F.lit(" .....  "))
    return docs(spark, d).select("doc_id", X.clean_page_text(raw).alias("cleaned"))


@query("clean_extract", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(split_part(text || chr(10) || 'References' || chr(10) || 'tail', chr(10) || 'References', 1) || chr(10), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS cleaned FROM docs", "docs")
def clean_extract(spark, d):
    raw = F.concat("text", F.lit("\nReferences\ntail"))
    return docs(spark, d).select("doc_id", X.clean_extract(raw).alias("cleaned"))


@query("clean_markdown_images", r"SELECT doc_id, regexp_replace(replace(replace(text, ' the ', chr(10) || chr(10) || chr(10) || chr(10)), ' and ', ' '), '\n{3,}', chr(10) || chr(10), 'g') AS cleaned FROM docs", "docs")
def clean_markdown_images(spark, d):
    raw = F.replace(F.replace("text", F.lit(" the "), F.lit("\n\n\n\n")), F.lit(" and "), F.lit("![x y](img/a.png) "))
    return docs(spark, d).select("doc_id", X.clean_markdown_images(raw).alias("cleaned"))


@query("needs_ocr_pages", r"SELECT doc_id, count(*) AS ocr_pages FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM docs) WHERE length(regexp_replace(t, '^\s+|\s+$', '', 'g')) < 16 GROUP BY doc_id", "docs")
def needs_ocr_pages(spark, d):
    return C.needs_ocr_pages(_pages(spark, d))


@query("segment_sentences")
def segment_sentences(spark, d):
    return C.segment_sentences(docs(spark, d))


@query("reassemble_sentences", "SELECT doc_id, md5(text) AS text_md5 FROM (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l: trim(l)), chr(10)) AS text FROM docs WHERE NOT regexp_matches(text, '[ \\t]{2,}|[…]'))", "docs")
def reassemble_sentences(spark, d):
    x = docs(spark, d).filter(~F.col("text").rlike(r"[ \t]{2,}|[…]"))
    # rows that share an id, or have none, are texts of their own
    keys = ["doc_id", "row"]
    sentences = C.segment_sentences(x.withColumn("row", F.monotonically_increasing_id()), keys)
    return C.reassemble_sentences(sentences, keys).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


PACKING = """WITH RECURSIVE k AS MATERIALIZED (SELECT doc_id, ordinal, token_count AS t, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS place FROM chunks),
r AS (SELECT doc_id, ordinal, place, 0::BIGINT AS n, t AS used FROM k WHERE place = 1 UNION ALL SELECT k.doc_id, k.ordinal, k.place, CASE WHEN r.used + k.t > 1000 THEN r.n + 1 ELSE r.n END, CASE WHEN r.used + k.t > 1000 THEN k.t ELSE r.used + k.t END FROM r JOIN k ON k.doc_id = r.doc_id AND k.place = r.place + 1)
SELECT doc_id, ordinal, n AS "window" FROM r"""


@query("pack_windows", PACKING, "chunks")
def pack_windows(spark, d):
    return C.pack_windows(chunks(spark, d), 1000)


def _unit_chunks(spark, d):
    c = chunks(spark, d).join(docs(spark, d).select("doc_id", "title"), "doc_id")
    return c.withColumn("heading_path", F.when(F.col("ordinal") >= 2, F.array(F.concat(F.lit("S"), F.floor(F.col("ordinal") / 7).cast("string")), F.concat(F.lit("P"), F.col("ordinal").cast("string")))))


@query("build_units")
def build_units(spark, d):
    return C.build_units(_unit_chunks(spark, d))


@query("unit_grounding")
def unit_grounding(spark, d):
    return K.unit_grounding(build_units(spark, d), chunks(spark, d))


@query("estimate_tokens", "SELECT chunk_id, ceil(length(text) / 3.5)::BIGINT AS tokens FROM chunks", "chunks")
def estimate_tokens(spark, d):
    return chunks(spark, d).select("chunk_id", X.estimate_tokens("text").alias("tokens"))


@query("sliding_context", "SELECT t.chunk_id AS target_id, c.chunk_id, c.doc_id, c.ordinal, c.chunk_id = t.chunk_id AS is_target FROM chunks t JOIN chunks c ON c.doc_id = t.doc_id AND c.ordinal BETWEEN t.ordinal - 1 AND t.ordinal + 2", "chunks")
def sliding_context(spark, d):
    c = chunks(spark, d)
    return C.sliding_context(c, c.select("chunk_id"), 1, 2)


# Filters


@query("ready_in_workspace", "SELECT doc_id FROM docs WHERE workspace_id = 2 AND status = 'ready'", "docs")
def ready_in_workspace(spark, d):
    return docs(spark, d).filter("workspace_id = 2 AND status = 'ready'").select("doc_id")


@query("focus_filter", "SELECT chunk_id FROM chunks WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)", "chunks")
def focus_filter(spark, d):
    focus = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    return chunks(spark, d).join(focus, "doc_id", "left_semi").select("chunk_id")


@query("like_literal", "SELECT doc_id FROM docs WHERE contains(lower(title), 'rc1_1')", "docs")
def like_literal(spark, d):
    return docs(spark, d).filter(X.contains_literal("title", F.lit("RC1_1"))).select("doc_id")


@query("size_date_filters", "SELECT doc_id FROM docs WHERE added_at >= 1704400000 AND byte_size >= 500 AND byte_size <= 5000", "docs")
def size_date_filters(spark, d):
    return docs(spark, d).filter("added_at >= 1704400000 AND byte_size >= 500 AND byte_size <= 5000").select("doc_id")


@query("classify_doc_type", "SELECT doc_id, ['pdf', 'docx', 'md', 'txt', 'code'][(doc_id % 5 + 1)::INT] AS doc_type FROM docs", "docs")
def classify_doc_type(spark, d):
    return docs(spark, d).select("doc_id", X.classify_doc_type("title").alias("doc_type"))


@query("mime_from_ext", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 2 THEN 'text/markdown' WHEN 3 THEN 'text/plain' END AS mime FROM docs", "docs")
def mime_from_ext(spark, d):
    return docs(spark, d).select("doc_id", X.mime_from_ext("title").alias("mime"))


@query("pinned_documents", "SELECT doc_id, title FROM docs WHERE doc_id % 25 = 0 ORDER BY title", "docs")
def pinned_documents(spark, d):
    return docs(spark, d).filter("doc_id % 25 = 0").select("doc_id", "title").orderBy("title", "doc_id")


@query("document_titles", "SELECT doc_id, title FROM docs WHERE status = 'ready'", "docs")
def document_titles(spark, d):
    return docs(spark, d).filter("status = 'ready'").select("doc_id", "title")


@query("good_chunk_filter", "SELECT chunk_id FROM chunks WHERE length(text) >= 200 AND len(regexp_extract_all(text, '[A-Za-z]')) >= 0.55 * length(text) AND len(list_filter(string_split_regex(text, '[^A-Za-z]+'), lambda w: length(w) >= 4)) >= 25", "chunks")
def good_chunk_filter(spark, d):
    words = F.size(F.filter(F.split("text", "[^A-Za-z]+"), lambda w: F.length(w) >= 4))
    return chunks(spark, d).filter((F.length("text") >= 200) & (100 * F.regexp_count("text", F.lit("[A-Za-z]")) >= 55 * F.length("text")) & (words >= 25)).select("chunk_id")


@query("source_for_chunk", "SELECT c.chunk_id, d.doc_id, d.title, c.ordinal + 1 AS page_from FROM chunks c JOIN docs d USING (doc_id)", "docs", "chunks")
def source_for_chunk(spark, d):
    return chunks(spark, d).join(docs(spark, d).select("doc_id", "title"), "doc_id").select("chunk_id", "doc_id", "title", (F.col("ordinal") + 1).alias("page_from"))


@query("status_counts", "SELECT workspace_id, status, count(*) AS n FROM docs GROUP BY 1, 2", "docs")
def status_counts(spark, d):
    return docs(spark, d).groupBy("workspace_id", "status").agg(F.count("*").alias("n"))


@query("seeded_sample")
def seeded_sample(spark, d):
    return K.seeded_sample(docs(spark, d).select("doc_id", "source"), "doc_id", 100, seed=42)


@query("stride_sample", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM docs) WHERE n <= 7 OR p IN (n * 0 // 7, n // 7, n * 2 // 7, n * 3 // 7, n * 4 // 7, n * 5 // 7, n * 6 // 7)", "docs")
def stride_sample(spark, d):
    return K.stride_sample(docs(spark, d), ["source"], ["doc_id"], 7).select("doc_id", "source")


@query("batch_assign", "SELECT doc_id, source || '-' || lpad(((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 15 + 1)::VARCHAR, 2, '0') AS batch FROM docs", "docs")
def batch_assign(spark, d):
    return K.batch_assign(docs(spark, d), "source", ["doc_id"]).select("doc_id", "batch")


@query("with_embedder", "SELECT chunk_id, length(text)::DOUBLE AS n_chars, len(string_split(text, ' '))::DOUBLE AS n_parts, 'stub' AS embedder_identity FROM chunks", "chunks")
def with_embedder(spark, d):
    @F.pandas_udf("array<double>")
    def stub(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(len(t)), float(t.count(" ") + 1)])

    out = U.with_embedder(chunks(spark, d), stub, identity="stub")
    return out.select("chunk_id", F.get("embedding", F.lit(0)).alias("n_chars"), F.get("embedding", F.lit(1)).alias("n_parts"), "embedder_identity")


@query("with_generator", "SELECT item_id AS query_id, reverse(text) AS raw FROM benchmark")
def with_generator(spark, d):
    @F.pandas_udf("string")
    def stub(prompts: pd.Series) -> pd.Series:
        return prompts.str[::-1]

    return U.with_generator(table(spark, d, "benchmark").withColumnRenamed("item_id", "query_id"), stub, "text").select("query_id", "raw")
