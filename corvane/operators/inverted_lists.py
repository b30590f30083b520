"""Approximate vector search: inverted lists, product-quantised residuals, exact re-ranking.

Unit vectors are dealt to lists by their nearest of ``lists`` k-means centroids; what is left of a
vector after its centroid is cut into ``parts`` pieces, each coded by one byte, its nearest of 256
codewords.  A query reads the ``probe`` lists whose centroids are nearest to it, scores their codes by
table look-ups (one sum of ``parts`` numbers a vector instead of a product of all dimensions), and only
the ``rerank`` best of them meet the query as whole vectors.

Centroids and codewords are learnt on a bounded sample, every vector is coded.  Codes are packed in
blocks of bounded bytes: a list of many vectors is cut into as many shards as it fills blocks, each
a group of its own when searched, so a hot list is no hot task.  Queries go to the shards they
probe, in groups of QUERIES; a task holds one block and one group.  The code of a 64-dimensional
vector takes 16 bytes against 512, and a list that no query probes isn't touched.  How many lists
have to be probed depends on the data: where vectors form clusters, a few; where they are spread evenly,
nearly all, and the saving is in codes and re-ranking.

Null, zero and odd-length vectors are not indexed.  The same vectors and seed give the same index.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_folder
from .lexical import top_per_group
from .vectors import cosine

#: Vectors the centroids and codewords are learnt from, rounds of k-means, bytes of codes in a block, queries in a group.
SAMPLE, ROUNDS, BLOCK_BYTES, QUERIES = 20_000, 12, 8 << 20, 2048
CODEWORDS = 256


def _units(rows: list, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and which of the rows have one."""
    good = np.array([r is not None and len(r) == dimension for r in rows], bool)
    m = np.array([r for r, g in zip(rows, good, strict=True) if g], float).reshape(-1, dimension)
    length = np.linalg.norm(m, axis=1)
    good[np.flatnonzero(good)[length == 0]] = False
    return m[length > 0] / length[length > 0, None], good


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points @ centres.T - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)


def k_means(points: np.ndarray, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most ``k`` centres; one without points takes the point that is worst served."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        of = nearest(points, centres)
        count = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, points)
        full = count > 0
        centres[full] = sums[full] / count[full, None]
        worst = np.argsort(-((points - centres[of]) ** 2).sum(axis=1))[: (~full).sum()]
        centres[np.flatnonzero(~full)[: len(worst)]] = points[worst]
    return centres


@dataclass
class Index:
    """Centroids (lists x dimension), codewords (parts x 256 x piece) and the table of blocks."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    words: np.ndarray

    @property
    def blocks(self) -> DataFrame:
        """(list, shard, ids, codes): one row a block."""
        return self.spark.read.schema(_BLOCKS).parquet(f"{self.path}/blocks")


_BLOCKS = "list int, shard int, ids array<long>, codes binary"


def build_index(vectors: DataFrame, lists: int = 64, parts: int = 16, sample: int = SAMPLE, seed: int = 0, id: str = "vec_id", vector: str = "embedding", path: str | None = None, block_bytes: int = BLOCK_BYTES) -> Index:
    """Learns from at most ``sample`` vectors, chosen by a hash of the id, and codes all."""
    spark = vectors.sparkSession
    path = path or new_folder(spark, "vectors")
    some = [r[0] for r in vectors.filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(id, F.lit(seed)), id).limit(sample).select(vector).collect()]
    dimension = len(some[0]) if some else parts
    if dimension % parts:
        raise ValueError(f"{parts} parts don't divide {dimension} dimensions")
    learnt, _ = _units(some, dimension)
    if not len(learnt):
        learnt = np.eye(1, dimension)
    centres = k_means(learnt, lists, seed)
    rest = (learnt - centres[nearest(learnt, centres)]).reshape(len(learnt), parts, -1)
    words = np.zeros((parts, CODEWORDS, dimension // parts))
    for j in range(parts):
        found = k_means(rest[:, j], CODEWORDS, seed + 1 + j)
        words[j, : len(found)] = found
        words[j, len(found) :] = found[0]

    def code(batches):
        for b in batches:
            m, good = _units(b.column(1).to_pylist(), dimension)
            at = nearest(m, centres)
            left = (m - centres[at]).reshape(len(m), parts, -1)
            codes = np.stack([nearest(left[:, j], words[j]) for j in range(parts)], axis=1).astype(np.uint8)
            ids = b.column(0).filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), ids, pa.array([c.tobytes() for c in codes], pa.binary())], ["list", "id", "code"])

    coded_path = f"{path}/coded"
    vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v")).mapInArrow(code, "list int, id long, code binary").write.parquet(coded_path)
    coded = spark.read.schema("list int, id long, code binary").parquet(coded_path)
    room = max(1, block_bytes // (parts + 8))
    shards = coded.groupBy("list").agg(F.ceil(F.count("*") / room).cast("int").alias("_shards"))  # one row a list

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        codes = b"".join(group["code"].to_pylist())
        first = group.slice(0, 1)
        return pa.table({"list": first["list"], "shard": first["shard"], "ids": pa.array([group["id"].to_pylist()], pa.list_(pa.int64())), "codes": pa.array([codes], pa.binary())})

    dealt = coded.join(F.broadcast(shards), "list").select("list", F.pmod(F.xxhash64("id"), F.col("_shards")).cast("int").alias("shard"), "id", "code")
    dealt.groupBy("list", "shard").applyInArrow(pack, _BLOCKS).write.parquet(f"{path}/blocks")
    model = [("centre", k, 0, c.tolist()) for k, c in enumerate(centres)] + [("word", j, k, w.tolist()) for j in range(parts) for k, w in enumerate(words[j])]
    spark.createDataFrame(model, "kind string, a int, b int, v array<double>").coalesce(1).write.parquet(f"{path}/model")
    return Index(spark, path, centres, words)


def open_index(spark: SparkSession, path: str) -> Index:
    """Opens an index that another session has written; the model has a bounded number of rows."""
    rows = spark.read.parquet(f"{path}/model").orderBy("kind", "a", "b").collect()
    words = [r.v for r in rows if r.kind == "word"]
    return Index(spark, path, np.array([r.v for r in rows if r.kind == "centre"]), np.array(words).reshape(-1, CODEWORDS, len(words[0])))


def probed(queries: DataFrame, index: Index, probe: int) -> DataFrame:
    """(query_id, list, unit): the ``probe`` nearest lists of every query with a direction."""
    centres = index.centres

    def choose(batches):
        for b in batches:
            m, good = _units(b.column(1).to_pylist(), centres.shape[1])
            order = np.argsort(-(m @ centres.T - 0.5 * (centres * centres).sum(axis=1)), axis=1, kind="stable")[:, :probe]
            n = order.shape[1]
            ids = np.repeat(b.column(0).filter(pa.array(good)).to_numpy(zero_copy_only=False), n)
            units = pa.array([u.tobytes() for u in m for _ in range(n)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(order.ravel().astype(np.int32)), units], ["query_id", "list", "unit"])

    return queries.select(F.col("query_id").cast("long"), "query_vector").mapInArrow(choose, "query_id long, list int, unit binary")


def candidates(queries: DataFrame, index: Index, probe: int, rerank: int) -> DataFrame:
    """(query_id, id, about, scanned): the ``rerank`` best codes of each query's lists, by estimated cosine.

    ``scanned`` is how many codes of the shard that the row comes from were scored for the query.
    """
    centres, words = index.centres, index.words
    blocks = index.blocks
    groups = max(1, -(-queries.count() // QUERIES))
    shards = blocks.groupBy("list").agg(F.max("shard").alias("_last"))  # one row a list
    asked = probed(queries, index, probe).withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(groups)))
    asked = asked.join(F.broadcast(shards), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("shard"), "part", "query_id", "unit")
    held = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def score(asking: pa.Table, block: pa.Table) -> pa.Table:
        out = {"query_id": [], "id": [], "about": [], "scanned": []}
        for list_, ids, codes in zip(block["list"].to_pylist(), block["ids"].to_pylist(), block["codes"].to_pylist(), strict=True):
            ids = np.array(ids, np.int64)
            codes = np.frombuffer(codes, np.uint8).reshape(len(ids), len(words))
            for q, unit in zip(asking["query_id"].to_pylist(), asking["unit"].to_pylist(), strict=True):
                unit = np.frombuffer(unit)
                table = np.einsum("jkd,jd->jk", words, unit.reshape(len(words), -1))
                about = unit @ centres[list_] + sum(table[j][codes[:, j]] for j in range(len(words)))
                n = min(rerank, len(ids))
                at = np.flatnonzero(about >= np.partition(about, len(ids) - n)[len(ids) - n])
                best = at[np.lexsort((ids[at], -about[at]))][:n]
                out["query_id"].append(np.full(len(best), q))
                out["id"].append(ids[best])
                out["about"].append(about[best])
                out["scanned"].append(np.full(len(best), len(ids)))
        return pa.table({k: np.concatenate(v) if v else np.zeros(0, np.float64 if k == "about" else np.int64) for k, v in out.items()})

    found = asked.groupBy("list", "shard", "part").cogroup(held.groupBy("list", "shard", "part")).applyInArrow(score, "query_id long, id long, about double, scanned long")
    return top_per_group(found, ["query_id"], [F.desc("about"), "id"], rerank, "_place").drop("_place")


def knn_ivf(queries: DataFrame, vectors: DataFrame, index: Index, k: int, probe: int, rerank: int, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Approximate top-k (query_id, rank, id, cosine); the cosines are exact."""
    if rerank < k:
        raise ValueError("rerank must be at least k")
    close = candidates(queries, index, probe, rerank).select("query_id", F.col("id").alias(id))
    scored = vectors.select(id, F.col(vector).alias("_v")).join(close, id).join(queries.select("query_id", "query_vector"), "query_id")
    return top_per_group(scored.withColumn("cosine", cosine("query_vector", "_v")), ["query_id"], [F.desc(F.round("cosine", 9)), id], k).select("query_id", "rank", id, "cosine")


def measured(queries: DataFrame, vectors: DataFrame, index: Index, k: int, probe: int, rerank: int, exact: DataFrame, id: str = "vec_id") -> DataFrame:
    """One row: recall against ``exact`` (query_id, id), and the shares of the vectors compared whole and scanned as codes, over all queries."""
    found = knn_ivf(queries, vectors, index, k, probe, rerank, id).select("query_id", id).withColumn("hit", F.lit(1.0))
    n = vectors.filter(F.col("embedding").isNotNull()).agg(F.count("*").alias("n"))
    sizes = index.blocks.groupBy("list").agg(F.sum(F.size("ids")).alias("size"))
    scanned = probed(queries, index, probe).join(sizes, "list").agg(F.sum("size").alias("scanned"), F.countDistinct("query_id").alias("asked"))
    compared = candidates(queries, index, probe, rerank).agg(F.count("*").alias("compared"))
    recall = exact.select("query_id", id).join(found, ["query_id", id], "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
    total = F.col("asked") * F.col("n")
    one = recall.crossJoin(n).crossJoin(scanned).crossJoin(compared)  # one row each
    return one.select("recall", (F.col("compared") / total).alias("share_compared"), (F.col("scanned") / total).alias("share_scanned"))
