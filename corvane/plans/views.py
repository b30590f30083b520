"""The driver's tables seen as a corpus: the same views for Spark and, as SQL text, for the twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_tokens
from ..operators.chunking import chunk_fixed
from ..sources.shared import new_folder

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

EXTENSIONS = ("pdf", "docx", "md", "txt", "py")
NOW = 1705000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes a core up to which a table is dealt out anew: less may be a file that only one task can read.
LITTLE = 32 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores if it is small; a large table has splits enough and is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, key) if size <= cores * LITTLE else df


def docs(spark, sf_dir, only: DataFrame | None = None) -> DataFrame:
    """The documents, or those of the table ``only`` (doc_id)."""
    d = table(spark, sf_dir, "documents")
    d = spread(d, "doc_id") if only is None else d.join(only, "doc_id", "left_semi")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select(
        "doc_id",
        "text",
        F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("title"),
        (F.col("doc_id") % 4).alias("workspace_id"),
        F.col("n_chars").alias("byte_size"),
        (F.lit(1704067200) + F.col("doc_id") * 3600).alias("added_at"),
        F.when(F.col("doc_id") % 17 == 0, "indexing").otherwise("ready").alias("status"),
        "lang",
        "source",
    )


def chunks(spark, sf_dir, only: DataFrame | None = None) -> DataFrame:
    c = chunk_fixed(docs(spark, sf_dir, only), "doc_id", "text", 512, 64)
    lang = F.when(F.col("lang").isin("de", "en"), F.col("lang")).otherwise("other")
    return c.select((F.col("doc_id") * 100000 + F.col("ordinal")).alias("chunk_id"), "doc_id", "ordinal", F.col("chunk_text").alias("text"), F.ceil(F.length("chunk_text") / 3.5).cast("long").alias("token_count"), lang.alias("language"))


def queries(spark, sf_dir) -> DataFrame:
    words = F.slice(F.split("text", " "), 1, 12)
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("query"))


def whole_queries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("doc_id"), "embedding")


def query_vectors(spark, sf_dir) -> DataFrame:
    return vectors(spark, sf_dir).filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("doc_id").alias("query_label"))


def messages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "conv_id", F.col("turn").alias("created_at"), "role", F.col("text").alias("content"))


def lines(spark, sf_dir) -> DataFrame:
    """One row for each order and line number: the table repeats some."""
    keys = ["l_orderkey", "l_linenumber"]
    values = ["l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag"]
    return table(spark, sf_dir, "lineitem").groupBy(*keys).agg(*(F.min(c).alias(c) for c in values))


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return new_folder(spark, "files")


# The twins' views. DuckDB's regular expressions have no look-around. The stopwords are fixed values.
_STOP = "['the','a','an','and','or','of','to','in','on','for','with','is','are','was','were','be','by','at','as','it','der','die','das','den','dem','des','ein','eine','einer','eines','und','oder','von','zu','im','auf','für','mit','ist','sind']"


def tokens_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^a-zA-Z0-9äöüß]+'), lambda t: t <> '' AND NOT list_contains({_STOP}, t))"


# Stems as in functions/stems.py, step by step over distinct words; doubled letters by name, since there are no back-references.
_GERMAN_STOP = "['der','die','das','den','dem','des','ein','eine','einer','eines','und','oder','von','zu','im','auf','für','mit','ist','sind']"
_ENGLISH_STOP = "['the','a','an','and','or','of','to','in','on','for','with','is','are','was','were','be','by','at','as','it']"


def _doubled(text: str) -> str:
    for c in "abcdefghijklmnopqrstuvwxyz0123456789$%&":
        text = f"replace({text}, '{c}{c}', '{c}*')"
    return text


def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^a-zA-Z0-9äöüß]+'), lambda t: t <> '')"


def stems_sql(words: str) -> str:
    """(word, german, english) of the rows (word) of ``words``."""
    groups = "replace(replace(replace(regexp_replace(replace(translate(word, 'äöü', 'aou'), 'ß', 'ss'), '^ge(.{4,})$', '\\1'), 'sch', '$'), 'ei', '%'), 'ie', '&')"
    german = f"replace(replace(replace(regexp_replace(regexp_replace({_doubled(groups)}, '^(?:(.{{3}})[tesn](?:e[mr]|nd|[tesn])*|(.{{4,}}?)(?:e[mr]|nd|[tesn])+)$', '\\1\\2'), '(.)\\*', '\\1\\1', 'g'), '$', 'sch'), '%', 'ei'), '&', 'ie')"
    return f"""SELECT word, german, regexp_replace(two, '^((?:[^aeiou][^aeiouy]*)?[aeiouy].*)y$', '\\1i') AS english FROM (
SELECT *, CASE WHEN regexp_matches(one, 'eed$') THEN regexp_replace(one, '^((?:[^aeiou][^aeiouy]*)?[aeiouy][aeiou]*[^aeiou][^aeiouy]*.*)eed$', '\\1ee')
  WHEN cut <> one AND regexp_matches(cut, '^(?:[^aeiou][^aeiouy]*)?[aeiouy]') THEN CASE WHEN regexp_matches(cut, '(?:at|bl|iz)$') THEN cut || 'e' WHEN substr(cut, -1, 1) = substr(cut, -2, 1) AND regexp_matches(cut, '..[^aeiouylsz]$') THEN left(cut, -1) WHEN regexp_matches(cut, '^[^aeiou][^aeiouy]*[aeiouy][^aeiouwxy]$') THEN cut || 'e' ELSE cut END
  ELSE one END AS two FROM (SELECT *, regexp_replace(one, '(?:ed|ing)$', '') AS cut FROM (SELECT word, {german} AS german, CASE WHEN length(word) <= 2 THEN word ELSE regexp_replace(regexp_replace(regexp_replace(word, 'sses$', 'ss'), 'ies$', 'i'), '([^s])s$', '\\1') END AS one FROM ({words}))))"""


VIEWS = {
    "whole_queries": "SELECT item_id AS query_id, text AS query FROM benchmark",
    "placed": f"SELECT chunk_id, ws[i + 1] AS word, i AS position FROM (SELECT chunk_id, ws, unnest(range(0, len(ws))) AS i FROM (SELECT chunk_id, {words_sql('c.text')} AS ws FROM chunks c))",
    "asked_words": f"SELECT DISTINCT query_id, unnest({words_sql('query')}) AS word FROM whole_queries",
    "stems": stems_sql("SELECT word FROM placed UNION SELECT word FROM asked_words"),
    "chunk_lexemes": f"SELECT chunk_id, german AS term, 'A' AS weight, position FROM placed JOIN stems USING (word) WHERE NOT list_contains({_GERMAN_STOP}, word) AND german <> '' UNION ALL SELECT chunk_id, english, 'B', position FROM placed JOIN stems USING (word) WHERE NOT list_contains({_ENGLISH_STOP}, word) AND english <> ''",
    "weighted": "SELECT chunk_id, term, tf, sum(tf) OVER (PARTITION BY chunk_id) AS len FROM (SELECT chunk_id, term, sum(CASE weight WHEN 'A' THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END) AS tf FROM chunk_lexemes GROUP BY 1, 2)",
    "stemmed_bm25": f"WITH q AS (SELECT query_id, german AS term FROM asked_words JOIN stems USING (word) WHERE NOT list_contains({_GERMAN_STOP}, word) UNION SELECT query_id, english FROM asked_words JOIN stems USING (word) WHERE NOT list_contains({_ENGLISH_STOP}, word)), n AS (SELECT count(*) AS n, avg(len) AS avg_len FROM (SELECT DISTINCT chunk_id, len FROM weighted)), f AS (SELECT term, count(*) AS df FROM weighted GROUP BY term) SELECT query_id, chunk_id, sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score FROM q JOIN weighted USING (term) JOIN f USING (term), n GROUP BY 1, 2",
    "docs": "SELECT doc_id, text, source || '_' || doc_id || '.' || ['pdf','docx','md','txt','py'][(doc_id % 5 + 1)::INT] AS title, doc_id % 4 AS workspace_id, n_chars AS byte_size, 1704067200 + doc_id * 3600 AS added_at, CASE WHEN doc_id % 17 = 0 THEN 'indexing' ELSE 'ready' END AS status, lang, source FROM documents",
    "chunks": r"SELECT doc_id * 100000 + i AS chunk_id, doc_id, i AS ordinal, t AS text, ceil(length(t) / 3.5)::BIGINT AS token_count, CASE WHEN lang IN ('de', 'en') THEN lang ELSE 'other' END AS language FROM (SELECT doc_id, lang, i, regexp_replace(substring(text, (i * 448 + 1)::BIGINT, 512), '^\s+|\s+$', '', 'g') AS t FROM (SELECT doc_id, lang, text, unnest(range(0, ((length(text) + 447) // 448)::BIGINT)) AS i FROM docs)) WHERE t <> ''",
    "queries": "SELECT item_id AS query_id, array_to_string(list_slice(string_split(text, ' '), 1, 12), ' ') AS query FROM benchmark",
    "vectors": "SELECT vec_id, label::BIGINT AS doc_id, embedding FROM embeddings",
    "query_vectors": "SELECT vec_id AS query_id, embedding AS query_vector, doc_id AS query_label FROM vectors WHERE vec_id % 50 = 0",
    "lines": "SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity, min(l_discount) AS l_discount, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2",
    "messages": "SELECT conv_id * 1000 + turn AS message_id, conv_id, turn AS created_at, role, text AS content FROM conversations",
    "cosines": "SELECT q.query_id, q.query_label, v.vec_id, v.doc_id, list_dot_product(q.query_vector::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.query_vector::DOUBLE[], q.query_vector::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))) AS cosine FROM query_vectors q CROSS JOIN vectors v",
    "terms": f"SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({tokens_sql('c.text')}) AS term FROM chunks c) GROUP BY 1, 2",
    "query_terms": f"SELECT DISTINCT query_id, unnest({tokens_sql('query')}) AS term FROM queries",
    "bm25": "SELECT q.query_id, t.chunk_id, sum(ln(1 + (n.n - f.df + 0.5) / (f.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * l.len / n.avg_len))) AS score FROM query_terms q JOIN terms t USING (term) JOIN (SELECT term, count(*) AS df FROM terms GROUP BY term) f USING (term) JOIN (SELECT chunk_id, sum(tf) AS len FROM terms GROUP BY chunk_id) l USING (chunk_id), (SELECT count(*) AS n, avg(len) AS avg_len FROM (SELECT chunk_id, sum(tf) AS len FROM terms GROUP BY chunk_id)) n GROUP BY 1, 2",
}
_NEEDS = {"placed": ("chunks",), "asked_words": ("whole_queries",), "stems": ("placed", "asked_words"), "chunk_lexemes": ("stems",), "weighted": ("chunk_lexemes",), "stemmed_bm25": ("weighted",), "chunks": ("docs",), "query_vectors": ("vectors",), "cosines": ("query_vectors",), "terms": ("chunks",), "query_terms": ("queries",), "bm25": ("query_terms", "terms")}


def twin(body: str, *views: str) -> str:
    """``body`` with the views it reads as common table expressions in front."""
    order: list[str] = []

    def add(v):
        for w in _NEEDS.get(v, ()):
            add(w)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    if not order:
        return body
    ctes = ", ".join(f"{v} AS MATERIALIZED ({VIEWS[v]})" for v in order)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[14:]}"
    return f"WITH {ctes}" + (", " + body[4:] if body.upper().startswith("WITH") else " " + body)


def query(name: str, sql: str | None = None, *views: str):
    """Registers the decorated (spark, sf_dir) function with its twin."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = twin(sql, *views)
        return f

    return register


__all__ = ["content_tokens"]
