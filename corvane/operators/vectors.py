"""Vector search by cosine similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .lexical import narrow, top_per_group  # noqa: F401 - narrow is part of vector search too

#: Bytes of query vectors that a task may hold; more queries are taken in blocks.
QUERY_BYTES = 64 << 20
#: Scores (queries times vectors) that a task has at a time.
SCORES = 1 << 21


def dot(a, b) -> Column:
    product = F.zip_with(F.col(a), F.col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(F.col(a), lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a, b) -> Column:
    """Null where a vector is null or zero."""
    return F.when((norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))


def validate_vectors(vectors: DataFrame, dimension: int, vector: str = "embedding") -> DataFrame:
    """Histogram of dimensions and whether each is the expected one."""
    return vectors.groupBy(F.size(vector).cast("long").alias("dimension")).agg(F.count("*").alias("n")).withColumn("valid", F.col("dimension") == dimension)


def _blocks(queries: DataFrame, dimension: int):
    """Query blocks of bounded size: (ids, unit vectors)."""
    n = queries.count()
    blocks = max(1, -(-n * dimension * 8 // QUERY_BYTES))
    for b in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else queries
        rows = part.select("query_id", "query_vector").collect()
        if rows:
            v = np.array([r.query_vector for r in rows], float)
            length = np.linalg.norm(v, axis=1, keepdims=True)
            yield np.array([r.query_id for r in rows]), np.divide(v, length, out=np.zeros_like(v), where=length > 0)


def _nearest(queries: DataFrame, vectors: DataFrame, k: int, id: str, vector: str, keys=None, others: bool = False) -> DataFrame:
    """(query_id, id, cosine) of what can be among the k nearest of each query.

    The queries go to every task in blocks of bounded size, each task multiplies matrices of bounded
    size and keeps k rows a query and batch, so neither vectors nor pairs are shuffled.  ``keys``: numbers of
    unit vectors by table; only pairs that share one count.  ``others``: a query is not its own neighbour.
    """
    first = queries.select(F.size("query_vector")).filter("query_vector IS NOT NULL").head()
    schema = StructType([StructField("query_id", LongType()), StructField(id, LongType()), StructField("cosine", DoubleType())])
    out = None
    for ids, unit in _blocks(queries.filter("query_vector IS NOT NULL"), first[0] if first else 1):

        def score(batches, ids=ids, unit=unit):
            asked = None if keys is None else keys(unit)
            for b in batches:
                b = b[b[vector].notna()]
                b = b[b[vector].map(len) == unit.shape[1]]
                if not len(b):
                    continue
                m = np.array(b[vector].tolist(), float)
                length = np.linalg.norm(m, axis=1)
                m, who = m[length > 0] / length[length > 0, None], b[id].to_numpy()[length > 0]
                n = min(k, len(who))
                if not n:
                    continue
                own = None if keys is None else keys(m)
                step = max(1, SCORES // len(who))
                for low in range(0, len(ids), step):
                    part = slice(low, low + step)
                    s = unit[part] @ m.T
                    near = np.round(s, 9)  # ties beyond the k-th go to the smaller id
                    if keys is not None:
                        met = np.zeros(s.shape, bool)
                        for t in range(own.shape[1]):
                            met |= asked[part, t, None] == own[None, :, t]
                        near[~met] = -np.inf
                    if others:
                        near[ids[part, None] == who[None]] = -np.inf
                    kth = np.partition(near, len(who) - n, axis=1)[:, len(who) - n]
                    q, v = np.nonzero((near >= kth[:, None]) & (near > -np.inf))
                    order = np.lexsort((who[v], -near[q, v], q))
                    q, v = q[order], v[order]
                    best = np.arange(len(q)) - np.searchsorted(q, q) < n
                    q, v = q[best], v[best]
                    yield pd.DataFrame({"query_id": ids[part][q], id: who[v], "cosine": s[q, v]})

        part = vectors.select(id, vector).mapInPandas(score, schema)
        out = part if out is None else out.unionByName(part)
    return vectors.sparkSession.createDataFrame([], schema) if out is None else out


def knn_exact(queries: DataFrame, vectors: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding", least: float | None = None, others: bool = False) -> DataFrame:
    """Top-k vectors of every query: (query_id, rank, id, cosine).

    Null vectors are skipped.  ``others``: a query is not its own neighbour.
    """
    out = _nearest(queries, vectors, k, id, vector, others=others)
    if least is not None:
        out = out.filter(F.col("cosine") >= least)
    return top_per_group(out, ["query_id"], [F.desc(F.round("cosine", 9)), id], k).select("query_id", "rank", id, "cosine")


def _scored(queries: DataFrame, vectors: DataFrame, id: str, vector: str, keep: tuple[str, ...], cut) -> DataFrame:
    """(query_id, id, keep..., cosine) of all queries with all vectors, in blocks of queries.

    ``cut`` takes the scored rows of one query and one batch of vectors and returns those to keep,
    before they leave the task.
    """
    first = queries.select(F.size("query_vector")).filter("query_vector IS NOT NULL").head()
    kinds = {f.name: f for f in vectors.schema.fields}
    schema = StructType([StructField("query_id", LongType()), *(kinds[c] for c in (id, *keep)), StructField("cosine", DoubleType())])
    out = None
    for ids, unit in _blocks(queries.filter("query_vector IS NOT NULL"), first[0] if first else 1):

        def score(batches, ids=ids, unit=unit):
            for b in batches:
                b = b[b[vector].notna()]
                b = b[b[vector].map(len) == unit.shape[1]]
                if not len(b):
                    continue
                m = np.array(b[vector].tolist(), float)
                length = np.linalg.norm(m, axis=1)
                rows = b.loc[length > 0, [id, *keep]].reset_index(drop=True)
                s = (m[length > 0] / length[length > 0, None]) @ unit.T
                for j in np.flatnonzero(np.abs(unit).sum(axis=1) > 0):
                    found = rows.assign(query_id=ids[j], cosine=s[:, j])
                    yield cut(found)[["query_id", id, *keep, "cosine"]]

        part = vectors.select(id, *keep, vector).mapInPandas(score, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else vectors.sparkSession.createDataFrame([], schema)


def all_scores(queries: DataFrame, vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Cosine of every stated query with every vector."""
    return _scored(queries, vectors, id, vector, keep, lambda rows: rows)


def knn_per_doc_cap(queries: DataFrame, vectors: DataFrame, k: int, cap: int, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Top-k of every query with at most ``cap`` vectors of a document."""

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_r=rows["cosine"].round(9)).sort_values(["_r", id], ascending=[False, True])
        return rows[rows.groupby("doc_id").cumcount() < cap]

    scored = _scored(queries, vectors, id, vector, ("doc_id",), cut)
    order = [F.desc(F.round("cosine", 9)), F.asc(id)]
    capped = top_per_group(scored, ["query_id", "doc_id"], order, cap, "_in_doc").drop("_in_doc")
    return top_per_group(capped, ["query_id"], order, k)


def knn_lsh(queries: DataFrame, vectors: DataFrame, k: int, tables: int = 12, bits: int = 6, seed: int = 0, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Approximate top-k: random hyperplane keys, exact cosine within shared keys.

    Keys are compared in the tasks, to which the queries go in blocks, so no row for a candidate is
    shuffled.  Vectors without a length have no cosine and are left out.
    """
    row = vectors.filter(F.col(vector).isNotNull()).select(vector).head()
    dimension = len(row[0]) if row else 1
    planes = np.random.default_rng(seed).normal(size=(dimension, tables * bits))

    def keys(m: np.ndarray) -> np.ndarray:
        return (m @ planes > 0).reshape(len(m), tables, bits) @ (1 << np.arange(bits))

    found = _nearest(queries, vectors, k, id, vector, keys=keys)
    return top_per_group(found, ["query_id"], [F.desc(F.round("cosine", 9)), id], k).select("query_id", "rank", id, "cosine")


def document_prefilter(similarity: DataFrame, n: int = 5, least: float = 0.2, focus: DataFrame | None = None) -> DataFrame:
    """Top-n documents of each query by summary similarity; a query without any is not narrowed."""
    if focus is not None:
        similarity = similarity.join(focus, ["query_id", "doc_id"], "left_semi")
    return top_per_group(similarity.filter(F.col("similarity") >= least), ["query_id"], [F.desc("similarity"), "doc_id"], n)


def hash_vectors(df: DataFrame, dimension: int, id: str = "id", text: str = "text") -> DataFrame:
    """Stand-in embedding (``id``, ``embedding``): counts of character codes modulo ``dimension``, unit
    length; zeros for a null or empty text."""

    @F.pandas_udf("array<double>")
    def counted(texts: pd.Series) -> pd.Series:
        texts = texts.fillna("").tolist()
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) % dimension
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        n = np.bincount(row * dimension + codes, minlength=len(texts) * dimension).reshape(-1, dimension).astype(float)
        length = np.sqrt((n * n).sum(axis=1, keepdims=True))
        return pd.Series(list(np.divide(n, length, out=np.zeros_like(n), where=length > 0)))

    return df.select(id, counted(text).alias("embedding"))


def knn_among(queries: DataFrame, vectors: DataFrame, allowed: DataFrame | None, k: int, cap: int, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """knn_per_doc_cap() where queries with rows in ``allowed`` (query_id, doc_id) see these documents only.

    For them it is an equi-join on the document; only the other queries are compared with all vectors.
    """
    if allowed is None:
        return knn_per_doc_cap(queries, vectors, k, cap, id, vector)
    pairs = queries.join(allowed.select("query_id", "doc_id").distinct(), "query_id").join(vectors.select(id, "doc_id", F.col(vector).alias("_v")), "doc_id")
    scored = pairs.withColumn("cosine", cosine("query_vector", "_v")).filter("cosine IS NOT NULL").select("query_id", id, "doc_id", "cosine")
    order = [F.desc(F.round("cosine", 9)), F.asc(id)]
    capped = top_per_group(scored, ["query_id", "doc_id"], order, cap, "_in_doc").drop("_in_doc")
    inside = top_per_group(capped, ["query_id"], order, k)
    free = queries.join(allowed.select("query_id"), "query_id", "left_anti")
    return inside.unionByName(knn_per_doc_cap(free, vectors, k, cap, id, vector).select(inside.columns))
