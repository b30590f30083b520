"""Near-duplicate documents with HyperMinHash registers (operator 6).

1. *Sketch.*  One pass hashes the word shingles of every text, counts the distinct ones and
   keeps per bucket of the hash range the smallest hash as a register: the count of leading
   zeros and the next mantissa bits.  Buckets that stay empty borrow a register by a fixed
   probing order, so sets of any size have comparable sketches.
2. *Classes.*  Documents with equal shingle sets form a class; the smallest id stands for it
   from here on, so thousands of copies cost one row.
3. *Bands.*  Groups of registers are hashed to keys; classes that share a key are candidates.
   With 5 registers a band and 32 bands a pair at similarity 0.8 is missed with odds of 3e-6.
   Sets of fewer than ``SMALL`` shingles, whose registers are mostly borrowed, also meet by their
   smallest hashes, so many that linked sets share one for certain, and are not judged by estimates.
   Random hubs stand for a key's members, so candidates stay linear in the members.
4. *Estimate.*  The share of equal registers, corrected for the expected accidental collisions,
   picks each class's best hub; pairs whose estimate is four standard errors too low are dropped.
5. *Verify.*  Links are confirmed on the full shingle sets: first each class's best hubs.
   Components so found that still have a possible pair between them (a shared key and a high
   enough estimate) make a cluster, and inside each cluster an index from shingle to class gives
   the exact intersections of all classes outside its largest component with all others.  So a
   component is whole even where a single pair links its members, and pairs inside it are never formed.

Defined results: a null or empty text, or one without words, has no shingles and is linked
with nothing; a text shorter than a shingle is its own only shingle; a null id counts as
smaller than all others; rows that repeat an id are each compared by their own text; ties and
repeated rows share a class; further columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .graph import connected_components, merge_components
from .io import table, written
from .pairing import Joined, block_edges, block_pairs, cross_component_pairs

NULL_ID = -(2**63)
REGISTERS, PER_BAND, MANTISSA = 160, 5, 10
BANDS = REGISTERS // PER_BAND
EMPTY = np.uint16(0xFFFF)
PROBES = 64
HUBS, FIRST = 3, 3
SMALL = 32
CLUSTER_BLOCK = 1024
_BUCKET = np.arange(REGISTERS, dtype=np.uint64)
_PROBE = np.stack([(K.mix(_BUCKET, 1000 + t) % np.uint64(REGISTERS)).astype(np.int64) for t in range(PROBES)])


def shingle_hashes(data, offsets, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each row, and their rows."""
    starts, ends, rows = K.words(data, offsets)
    n = len(offsets) - 1
    hashes = K.span_hashes(K.prefix_sums(data, fold=True), starts, ends)
    first, keys = K.windows(hashes, rows, width)
    keys, at = K.mix(keys, 4), rows[first]
    word_at = K.row_starts(rows, n)
    count = np.diff(word_at)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        up, down = K.powers(K.BASE_B).upto(len(hashes) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate(([np.uint64(0)], np.cumsum(hashes * up[: len(hashes)])))
            whole = (sums[word_at[short + 1]] - sums[word_at[short]]) * down[word_at[short]] + count[short].astype(np.uint64)
        keys, at = np.concatenate((keys, K.mix(whole, 5))), np.concatenate((at, short))
    order = np.argsort((at.astype(np.uint64) << np.uint64(44)) | (keys >> np.uint64(20)), kind="stable")
    keys, at = keys[order], at[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (at[1:] != at[:-1])
    return keys[new], at[new]


def registers(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Registers (n x REGISTERS) of rows' distinct hashes, which ascend within each row."""
    scaled = (keys >> np.uint64(32)) * np.uint64(REGISTERS)
    cell = rows * REGISTERS + (scaled >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    least = (scaled[first] & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    bits = np.floor(np.log2(least.astype(np.float64))).astype(np.uint64)  # place of the leading one
    zeros = np.uint64(31) - bits
    mantissa = np.where(bits >= MANTISSA, least >> (np.maximum(bits, MANTISSA) - np.uint64(MANTISSA)), least << (np.uint64(MANTISSA) - np.minimum(bits, MANTISSA))) & np.uint64((1 << MANTISSA) - 1)
    raw = np.full(n * REGISTERS, EMPTY, np.uint16)
    raw[cell[first]] = (zeros << np.uint64(MANTISSA)) | mantissa
    raw = raw.reshape(n, REGISTERS)
    out = raw.copy()
    row, col = np.nonzero((raw == EMPTY) & (raw != EMPTY).any(axis=1)[:, None])
    for t in range(PROBES):
        if not len(row):
            break
        found = raw[row, _PROBE[t, col]]
        out[row, col] = found
        left = found == EMPTY
        row, col = row[left], col[left]
    if len(row):  # sets of very few shingles
        out[row, col] = raw[row, (raw[row] != EMPTY).argmax(axis=1)]
    return out


_SKETCH = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("registers", pa.binary()), ("least", pa.list_(pa.int64()))])
_SKETCH_DDL = "id long, n long, set_a long, set_b long, registers binary, least array<long>"


def _sketch(width: int, percent: int):
    def sketch(batches):
        for batch in batches:
            ids = batch.column("id")
            for at, n, data, offsets in K.string_chunks(batch.column("text")):
                keys, rows = shingle_hashes(data, offsets, width)
                cuts = K.row_starts(rows, n)
                sums = []
                for salt in (6, 7):
                    with np.errstate(over="ignore"):
                        total = np.concatenate(([np.uint64(0)], np.cumsum(K.mix(keys, salt))))
                    sums.append((total[cuts[1:]] - total[cuts[:-1]]).view(np.int64))
                found = registers(keys, rows, n)
                size = np.diff(cuts)
                # two sets that share percent of both lack few of each other's hashes, so their smallest meet
                few = np.where((size > 0) & (size < SMALL), size + 1 + (-size * percent // 100), 0)
                least = [keys[a : a + k].view(np.int64) for a, k in zip(cuts[:-1], few, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, n), pa.array(np.diff(cuts)), pa.array(sums[0]), pa.array(sums[1]), pa.array([r.tobytes() for r in found], pa.binary()), pa.array(least, pa.list_(pa.int64()))], schema=_SKETCH)

    return sketch


def _sets(width: int):
    def sets(batches):
        for batch in batches:
            for at, n, data, offsets in K.string_chunks(batch.column("text")):
                keys, rows = shingle_hashes(data, offsets, width)
                cuts = K.row_starts(rows, n).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, n), pa.ListArray.from_arrays(pa.array(cuts), pa.array(keys.view(np.int64)))], names=["id", "shingles"])

    return sets


def _accidental(n: np.ndarray) -> np.ndarray:
    """Odds, by levels of leading zeros, of a register of a set of ``n`` shingles."""
    load = np.maximum(n / REGISTERS, 1.0)[:, None]
    level = 2.0 ** -np.arange(33)
    return np.exp(-load * level[1:]) - np.exp(-load * level[:-1])


def estimate(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers less the accidental collisions."""
    chance = (_accidental(n_a) * _accidental(n_b)).sum(axis=1) / (1 << MANTISSA)
    return (equal / REGISTERS - chance) / (1 - chance)


def _lowest(percent: int) -> float:
    """Four standard errors below the threshold."""
    j = percent / 100
    return j - 4 * (j * (1 - j) / REGISTERS) ** 0.5


def _regs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _estimated(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        equal = (_regs(batch.column("regs_a")) == _regs(batch.column("regs_b"))).sum(axis=1)
        n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(estimate(equal, n_a, n_b)), pa.array(np.minimum(n_a, n_b))], names=["a", "b", "j", "n"])


def _near(percent: int):
    """Which members may be linked to row ``f``, by sizes and estimates, and the estimates."""

    def near(columns, f, members):
        n = columns["n"]
        low, high = np.minimum(n[members], n[f]), np.maximum(n[members], n[f])
        members = members[100 * low >= percent * high]
        if not len(members):
            return members, np.zeros(0)
        own = np.frombuffer(columns["registers"][f], np.uint16)
        equal = (np.frombuffer(b"".join([columns["registers"][m] for m in members]), np.uint16).reshape(-1, REGISTERS) == own).sum(axis=1)
        j = estimate(equal, n[members], np.full(len(members), n[f]))
        fine = (j >= _lowest(percent)) | (np.minimum(n[members], n[f]) < SMALL)
        return members[fine], j[fine]

    return near


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(a, "a").join(b, "b").filter(100 * both >= percent * (F.size("of_a") + F.size("of_b") - both)).select("a", "b")


def _linked(percent: int):
    """Links between components inside each cluster's block, as many as connect what is linked there.

    An index from shingle to members gives a class's intersections with all members at once.
    """

    def linked(rows: pa.Table) -> pa.Table:
        cluster, i, j, node, comp, n, probe = (rows[c].to_numpy() for c in ("cluster", "i", "j", "node", "comp", "n", "probe"))
        lists = rows["shingles"].combine_chunks()
        values, cuts = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        order, edges = block_edges(cluster, i, j, node)
        joined = Joined(comp)
        a, b = [], []
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            at = order[x:y]
            members = at[~probe[at]]
            if not len(members):
                continue
            keys = np.concatenate([values[cuts[m] : cuts[m + 1]] for m in members])
            owner = np.repeat(np.arange(len(members)), n[members])
            by = np.argsort(keys, kind="stable")
            keys, owner = keys[by], owner[by]
            for f in at[probe[at]]:
                mine = values[cuts[f] : cuts[f + 1]]
                low, high = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
                size = high - low
                places = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
                both = np.bincount(owner[places], minlength=len(members))
                hit = np.flatnonzero((100 * both >= percent * (n[f] + n[members] - both)) & (joined.labels(members) != joined.labels(f)))
                if len(hit):
                    new = joined.first(f, members[hit])
                    a += [node[f]] * len(new)
                    b += node[new].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return linked


def _links_across(clusters: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links between the components of each cluster (node, component), on full sets.

    Classes outside a cluster's largest component are compared with all its classes, in pairs of
    bounded blocks.
    """
    nodes = clusters.withColumnRenamed("component", "cluster").join(found.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    left = written(block_pairs(nodes, "cluster", CLUSTER_BLOCK).select("cluster", "node", "comp", "i", "j", "probe"))
    rows = left.join(sets.select(F.col("id").alias("node"), F.size("shingles").cast("long").alias("n"), "shingles"), "node")
    groups = max(512, left.count() // 1024)
    return rows.groupBy(F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(groups))).applyInArrow(_linked(percent), "a long, b long")


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``df``: id, ``n_shingles``, ``component_id`` and ``kept``.

    Two documents are linked where 100 * intersection >= ``percent`` * union of their sets of
    ``width``-word shingles (A-Z lower-cased); ``component_id`` is the smallest id reachable
    over links and ``kept`` marks the row that has it as its id.
    """
    docs = df.select(F.coalesce(F.col(id).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sketches = written(docs.mapInArrow(_sketch(width, percent), _SKETCH_DDL))
    classes = sketches.filter("n > 0").groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    reps = written(sketches.join(classes.select("set_a", "set_b", F.col("rep").alias("id")), ["set_a", "set_b", "id"]).select(F.col("id").alias("rep"), "n", "registers", "least").dropDuplicates(["rep"]))

    bytes_of = 2 * PER_BAND
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(F.substring(F.col("registers"), i * bytes_of + 1, F.lit(bytes_of)), i))
    small = F.transform("least", lambda x: F.xxhash64(x, F.lit("small")))
    banded = reps.select("rep", "n", F.explode(F.concat(keys, small)).alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    active = written(banded.join(shared, "key"))

    hubs = active.groupBy("key").agg(F.array(*(F.min(F.struct(F.xxhash64("rep", F.lit(h)).alias("h"), "rep", "n")) for h in range(HUBS))).alias("hubs"))
    to_hub = active.join(hubs, "key").select("rep", "n", F.explode("hubs").alias("hub")).filter("rep <> hub.rep")
    close = 100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")
    pairs = to_hub.filter(close).select(F.col("rep").alias("a"), F.col("hub.rep").alias("b")).distinct()
    regs = reps.join(active.select("rep").distinct(), "rep", "left_semi")
    side = lambda s: regs.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("registers").alias(f"regs_{s}"))
    judged = written(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_estimated, "a long, b long, j double, n long").filter((F.col("j") >= _lowest(percent)) | (F.col("n") < SMALL)))

    wanted = active.select(F.col("rep").alias("id")).distinct()
    sets = written(docs.join(wanted, "id", "left_semi").mapInArrow(_sets(width), "id long, shingles array<long>"))
    ordered = lambda p: p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # a class has at most HUBS hubs a band, so its list is bounded
    best = judged.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("j")).alias("j"), "b"))), 1, FIRST).alias("best"))
    found = connected_components(_verified(ordered(best.select("a", F.explode("best.b").alias("b"))), sets, percent))

    across = cross_component_pairs(active, found, "rep", ("n", "registers"), _near(percent), reps.select("rep", "registers"), connect=True)
    clusters = merge_components(found, across)
    found = merge_components(found, _links_across(clusters, found, sets, percent))

    labelled = written(classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("set_a", "set_b", "copies", F.coalesce("component", "rep").alias("component")))
    # classes with more than a thousandth of all rows are a thousand at most: their rows stay where they are
    often = F.broadcast(labelled.filter(F.col("copies") > sketches.count() / 1000).select("set_a", "set_b", "component"))
    key, rows = ["set_a", "set_b"], sketches.select("id", "n", "set_a", "set_b")
    full = rows.filter("n > 0")
    joined = full.join(often, key).unionByName(full.join(often, key, "left_anti").join(labelled.join(often, key, "left_anti").drop("copies"), key))
    joined = joined.unionByName(rows.filter("n = 0").withColumn("component", F.lit(None).cast("long")))
    component = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    real = lambda c: F.when(c != NULL_ID, c)
    return joined.select(real(F.col("id")).alias(id), F.col("n").alias("n_shingles"), real(component).alias("component_id"), (component == F.col("id")).alias("kept"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles at similarity 0.8 over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_sets FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_sets >= 80 * (x.n + y.n - both_sets)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.reach),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
