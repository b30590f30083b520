"""A stored index of stemmed postings in two languages, and searches that read only its parts they need.

Every chunk counts under two configurations: German stems with weight A, English stems with weight B.
A query's lexemes are the stems of its words under both, so "Verträge" finds "Vertrag" and "houses"
finds "house" whatever the language of query and chunk.

The index is three tables in the shared folder:

- ``words``: (slot, term, df, shards, most), one row a term, bucketed and sorted by the term's hash;
- ``blocks``: up to BLOCK postings of one term a row, the strongest in the first block, with the block's
  greatest gain, bucketed and sorted by the hash of (term, shard).  A term of more than SHARD chunks is dealt
  over several shards, so no bucket or task holds a frequent term whole;
- ``stats``: one row of counts and settings.

Counts are kept as whole numbers (fifths, since the weights are 1 and 0.4), from which gains are computed
when a block is opened.  The words of a chunk are stemmed and counted in the task that cuts them, once for the
statistics and once for the lists: the only shuffle of postings is that of lists, one a term and batch.

A search looks its terms up in ``words``, then reads the buckets, and inside them the row groups, of
its terms' shards: both filters are literals, so Spark prunes buckets while planning.  More terms
than LITERALS are joined on the bucketed hash instead, without a shuffle of the index.  The first
block of every list gives each query a score that its k-th hit reaches at least; blocks which, with
the best of the query's other terms, stay below that are dropped before their postings are unpacked.
That loses nothing: a chunk in a dropped block can't be among the k.  It saves most where a query's
terms are all frequent; beside a rare term, which any block may meet, few blocks fall.  The postings that
remain are dealt out by document, once for all queries, with the ids of the documents that may be found;
a task sums the scores of its documents and gives their k best hits of each query, so no row a pair of query and
chunk is shuffled.  A stopword of one language is a word of the other.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stems import ENGLISH_STOP, GERMAN_STOP, stems, with_stems
from ..functions.text import words_without
from ..sources.shared import new_folder, written
from .lexical import B, K1, SMALL_CHARS, SMALL_ROWS, TOKEN, narrow, per_document_cap, top_per_group

#: Weights of a match under the German and the English configuration.
WEIGHT_A, WEIGHT_B = 1.0, 0.4
#: Postings in a block, chunks of a term in a shard, and terms up to which filters are literals.
BLOCK, SHARD, LITERALS = 128, 1 << 20, 20_000
#: The weights in fifths, and postings of a bucket.
UNIT, UNITS_A, UNITS_B = 5, 5, 2
BUCKET = 1 << 22
#: Cells (chunk, query) that a task scores at a time, and what rounded scores may differ by.
CELLS, NEAR = 1 << 20, 3e-9


def lexemes(texts: DataFrame, *ids: str, text: str = "text") -> DataFrame:
    """(ids..., term, weight, position): the stems of each word under both configurations.

    Positions count the words of the text, stopwords included.
    """
    words = with_stems(texts.select(*ids, F.posexplode(words_without(text, ())).alias("position", "word")))
    both = F.array(
        F.struct(F.when(~F.col("word").isin(*GERMAN_STOP), F.col("german")).alias("term"), F.lit("A").alias("weight")),
        F.struct(F.when(~F.col("word").isin(*ENGLISH_STOP), F.col("english")).alias("term"), F.lit("B").alias("weight")),
    )
    return words.select(*ids, F.inline(both), "position").filter("term IS NOT NULL AND term <> ''")


def query_lexemes(queries: DataFrame) -> DataFrame:
    """Distinct (query_id, term) under both configurations."""
    return lexemes(queries, "query_id", text="query").select("query_id", "term").distinct()


def weighted_postings(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, term, tf, len): counts weighted by configuration, and the chunk's sum of them."""
    weight = F.when(F.col("weight") == "A", F.lit(WEIGHT_A)).otherwise(F.lit(WEIGHT_B))
    counted = lexemes(chunks, "doc_id", "chunk_id").groupBy("doc_id", "chunk_id", "term").agg(F.sum(weight).alias("tf"))
    return counted.withColumn("len", F.sum("tf").over(Window.partitionBy("doc_id", "chunk_id")))


def _counted(batch):
    """Row, term number and units of each term of each text of a batch, by row, and the terms."""
    found = [TOKEN.findall(t) if t else [] for t in batch.column("text").to_pylist()]
    row = np.repeat(np.arange(len(found)), [len(x) for x in found])
    tokens = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
    number: dict[str, int] = {}
    of = np.full((2, len(tokens.dictionary)), -1, np.int64)
    for j, word in enumerate(tokens.dictionary.to_pylist()):
        for side, (stem, stop) in enumerate(zip(stems(word), (GERMAN_STOP, ENGLISH_STOP), strict=True)):
            if stem and word not in stop:
                of[side, j] = number.setdefault(stem, len(number))
    at = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    term, units = of[:, at].ravel(), np.repeat([UNITS_A, UNITS_B], len(at))
    real = term >= 0
    several = max(len(number), 1)
    cell, by = np.unique(np.tile(row, 2)[real] * several + term[real], return_inverse=True)
    row, term = np.divmod(cell, several)
    return row, term, np.bincount(by, weights=units[real], minlength=len(cell)).astype(np.int64), list(number)


_MEASURED = pa.schema([("doc_id", pa.int64()), ("chunk_id", pa.int64()), ("units", pa.int64()), ("term", pa.string()), ("df", pa.int64())])


def _measure(batches):
    """A row (doc_id, chunk_id, units) for each chunk and (term, df) for each term of a batch."""
    for batch in batches:
        row, term, units, words = _counted(batch)
        n, none = batch.num_rows, pa.nulls
        size = np.bincount(row, weights=units, minlength=n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("chunk_id"), pa.array(size), none(n, pa.string()), none(n, pa.int64())], schema=_MEASURED)
        m = len(words)
        yield pa.RecordBatch.from_arrays([none(m, pa.int64())] * 3 + [pa.array(words, pa.string()), pa.array(np.bincount(term, minlength=m))], schema=_MEASURED)


_LISTS = "term string, shard int, doc_ids array<long>, chunk_ids array<long>, tf array<int>, len array<int>"


def _lists(shards: dict[str, int]):
    """The postings of a batch of chunks, a row for each term and shard."""

    def lists(batches):
        for batch in batches:
            row, term, units, words = _counted(batch)
            if not len(row):
                continue
            size = np.bincount(row, weights=units, minlength=batch.num_rows).astype(np.int64)
            many = np.array([shards.get(w, 1) for w in words], np.int64)
            chunk, doc = batch.column("chunk_id"), batch.column("doc_id")
            mixed = (pc.fill_null(chunk, 0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            shard = mixed[row].astype(np.int64) % many[term]
            order = np.lexsort((row, shard, term))
            row, term, units, shard = row[order], term[order], units[order], shard[order]
            first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (shard[1:] != shard[:-1])))
            cuts = pa.array(np.append(first, len(row)).astype(np.int32))
            listed = (pa.ListArray.from_arrays(cuts, x) for x in (doc.take(pa.array(row)), chunk.take(pa.array(row)), pa.array(units.astype(np.int32)), pa.array(size[row].astype(np.int32))))
            yield pa.RecordBatch.from_arrays([pa.array([words[t] for t in term[first]], pa.string()), pa.array(shard[first].astype(np.int32)), *listed], names=["term", "shard", "doc_ids", "chunk_ids", "tf", "len"])

    return lists


_POSTING = pa.struct([("doc_id", pa.int64()), ("chunk_id", pa.int64()), ("tf", pa.int32()), ("len", pa.int32())])


def _blocks(average: float, k1: float, b: float, block: int):
    """Lists sorted by slot, term and shard to blocks; besides the batch, no more than one shard of a term is held."""
    keys, lists = ["slot", "term", "shard"], ["doc_ids", "chunk_ids", "tf", "len"]

    def cut(rows: pa.Table):
        """All blocks of rows with whole keys."""
        rows = rows.combine_chunks()
        slot, term, shard = (rows[c].combine_chunks() for c in keys)
        _, name = np.unique(term.dictionary_encode().indices.to_numpy(), return_inverse=True)
        new = np.append(True, (np.diff(slot.to_numpy()) != 0) | (np.diff(name) != 0) | (np.diff(shard.to_numpy()) != 0))
        size = rows["tf"].combine_chunks().value_lengths().to_numpy()
        key = np.repeat(np.cumsum(new) - 1, size)
        doc, chunk, tf, length = (rows[c].combine_chunks().flatten() for c in lists)
        worth = gain(tf.to_numpy() / UNIT, length.to_numpy() / UNIT, average, k1, b)
        ids = pc.fill_null(chunk, np.iinfo(np.int64).min).to_numpy()
        by = np.lexsort((ids, -worth, key))
        key = key[by]
        number = (np.arange(len(key)) - np.searchsorted(key, key)) // block
        # inside a block by id
        again = np.lexsort((ids[by], number, key))
        by, key, number = by[again], key[again], number[again]
        at = np.flatnonzero(np.append(True, (np.diff(key) != 0) | (np.diff(number) != 0)))
        cuts, whole = np.append(at, len(key)), pa.array(np.flatnonzero(new)[key[at]])
        postings = pa.StructArray.from_arrays([x.take(pa.array(by)) for x in (doc, chunk, tf, length)], fields=list(_POSTING))
        return pa.RecordBatch.from_arrays([*(x.take(whole) for x in (slot, term, shard)), pa.array(number[at].astype(np.int32)), pa.array(np.diff(cuts).astype(np.int32)), pa.array(np.maximum.reduceat(worth[by], at)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), postings)], names=[*keys, "block", "n", "most", "postings"])

    def blocks(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in keys):
                yield cut(pa.Table.from_batches(held))
                held = []
            last = n - 1
            while last and all(batch.column(c)[last - 1] == batch.column(c)[n - 1] for c in keys):
                last -= 1
            if last:
                yield cut(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield cut(pa.Table.from_batches(held))

    return blocks


def gain(tf, length, average, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def inverse_frequency(n, df) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def scan_search(queries: DataFrame, chunks: DataFrame, docs: DataFrame, k: int = 10, cap: int | None = 3) -> DataFrame:
    """search_stored() without an index: every chunk is tokenised and every posting scored."""
    found = written(weighted_postings(chunks))
    n, average = found.dropDuplicates(["chunk_id"]).agg(F.count("*"), F.avg("len")).first()
    asked = query_lexemes(queries).join(found.groupBy("term").agg(F.count("*").alias("df")), "term")
    scored = found.join(asked, "term").withColumn("part", inverse_frequency(F.lit(n or 0), F.col("df")) * gain(F.col("tf"), F.col("len"), F.lit(average or 1.0)))
    return _top(scored.groupBy("query_id", "doc_id", "chunk_id").agg(F.sum("part").alias("score")), docs, k, cap, None)


def _top(scores: DataFrame, docs: DataFrame, k: int, cap: int | None, allowed: DataFrame | None) -> DataFrame:
    scores = scores.join(docs.filter("status = 'ready'").select("doc_id"), "doc_id", "left_semi")
    scores = narrow(scores, allowed) if allowed is not None else scores
    scores = per_document_cap(scores, cap) if cap is not None else scores
    return top_per_group(scores, ["query_id"], [F.desc(F.round("score", 9)), "chunk_id"], k).select("query_id", "rank", "chunk_id", "doc_id", "score")


def slot_of(term, shard) -> Column:
    return F.xxhash64(term, shard)


@dataclass
class Store:
    """An open index."""

    spark: SparkSession
    path: str
    n: int
    average: float
    buckets: int
    k1: float
    b: float
    name: str

    def table(self, kind: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{kind}")

    def postings(self, blocks: DataFrame, *columns: str) -> DataFrame:
        """(columns..., doc_id, chunk_id, tf, gain) of the postings in ``blocks``."""
        tf, length = F.col("tf") / UNIT, F.col("len") / UNIT
        rows = blocks.select(*columns, F.inline("postings"))
        return rows.select(*columns, "doc_id", "chunk_id", tf.alias("tf"), gain(tf, length, F.lit(self.average), self.k1, self.b).alias("gain"))


_COLUMNS = {
    "words": "slot bigint, term string, df bigint, shards int, most double",
    "blocks": "slot bigint, term string, shard int, block int, n int, most double, postings array<struct<doc_id: bigint, chunk_id: bigint, tf: int, len: int>>",
}


def build_store(chunks: DataFrame, path: str | None = None, buckets: int | None = None, k1: float = K1, b: float = B, shard: int = SHARD, block: int = BLOCK) -> Store:
    """Writes the index of all chunks (doc_id, chunk_id, text) and opens it.

    Without ``buckets`` their number follows from that of the postings.
    """
    spark = chunks.sparkSession
    path = path or new_folder(spark, "postings")
    texts = chunks.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("chunk_id").cast("long").alias("chunk_id"), F.lower("text").alias("text"))
    ids = ["doc_id", "chunk_id"]
    measured = written(texts.mapInArrow(_measure, "doc_id long, chunk_id long, units long, term string, df long"))
    sizes = measured.filter("term IS NULL").select(*ids, "units")
    repeated = written(sizes.groupBy(*ids).agg(F.count("*").alias("rows"), F.sum("units").alias("units")).filter("rows > 1").select(*ids, "units"))
    if not repeated.isEmpty():
        # rows that repeat an id are one chunk
        texts = texts.groupBy(*ids).agg(F.array_join(F.collect_list("text"), " ").alias("text"))
        measured = written(texts.mapInArrow(_measure, "doc_id long, chunk_id long, units long, term string, df long"))
        sizes = measured.filter("term IS NULL").select(*ids, "units")
    n, average = sizes.filter("units > 0").dropDuplicates(["chunk_id"]).agg(F.count("*"), F.avg("units")).first()
    average = average / UNIT if average else 1.0
    counts = written(measured.filter("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df")).withColumn("shards", F.ceil(F.col("df") / shard).cast("int")))
    buckets = buckets or max(16, -(-(counts.agg(F.sum("df")).first()[0] or 0) // BUCKET))
    # terms of more than one shard: at most as many as the postings fill shards
    frequent = {r.term: r.shards for r in counts.filter("shards > 1").collect()}
    dealt = texts.mapInArrow(_lists(frequent), _LISTS).withColumn("slot", slot_of("term", "shard")).repartition(buckets, "slot").sortWithinPartitions("slot", "term", "shard")
    blocks = dealt.mapInArrow(_blocks(float(average), k1, b, block), _COLUMNS["blocks"])
    name = f"postings_{uuid.uuid4().hex}"

    def store(kind: str, df: DataFrame) -> None:
        df.write.bucketBy(buckets, "slot").sortBy("slot").option("path", f"{path}/{kind}").option("compression", "zstd").format("parquet").saveAsTable(f"{name}_{kind}")

    store("blocks", blocks)
    most = spark.table(f"{name}_blocks").groupBy("term").agg(F.max("most").alias("most"))
    store("words", counts.join(most, "term").withColumn("slot", F.xxhash64("term")).select("slot", "term", "df", "shards", "most").repartition(buckets, "slot"))
    spark.createDataFrame([(n, float(average), buckets, k1, b)], "n long, average double, buckets int, k1 double, b double").write.parquet(f"{path}/stats")
    return Store(spark, path, n, float(average), buckets, k1, b, name)


def open_store(spark: SparkSession, path: str) -> Store:
    """Opens an index that another session has written."""
    stats = spark.read.parquet(f"{path}/stats").first()
    name = f"postings_{uuid.uuid4().hex}"
    for kind, columns in _COLUMNS.items():
        spark.sql(f"CREATE TABLE {name}_{kind} ({columns}) USING parquet CLUSTERED BY (slot) SORTED BY (slot) INTO {stats.buckets} BUCKETS LOCATION '{path}/{kind}'")
    return Store(spark, path, stats.n, stats.average, stats.buckets, stats.k1, stats.b, name)


def _small(df: DataFrame) -> tuple[int, int]:
    return df.agg(F.count("*"), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()


def asked_blocks(store: Store, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The queries' terms (query_id, term, idf, bound) and the blocks of these terms."""
    terms = written(query_lexemes(queries).withColumn("slot", F.xxhash64("term")))
    distinct = terms.select("slot", "term").distinct()
    n, chars = _small(distinct)
    few = n <= LITERALS and chars <= SMALL_CHARS
    words = store.table("words")
    if few:
        words = words.filter(F.col("slot").isin([r[0] for r in distinct.select("slot").distinct().collect()]))
    idf = inverse_frequency(F.lit(store.n), F.col("df"))
    known = written(terms.join(words, ["slot", "term"]).select("query_id", "term", "shards", idf.alias("idf"), (idf * F.col("most")).alias("bound")))
    lists = known.select("term", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")).distinct().withColumn("slot", slot_of("term", "shard"))
    blocks = store.table("blocks")
    slots = [r[0] for r in lists.select("slot").distinct().limit(LITERALS + 1).collect()] if few else []
    if few and len(slots) <= LITERALS:
        blocks = blocks.filter(F.col("slot").isin(slots))
    # a hash may stand for two terms: the join on the term decides
    return known.select("query_id", "term", "idf", "bound"), blocks.join(lists.hint("broadcast") if n <= SMALL_ROWS and chars <= SMALL_CHARS else lists, ["slot", "term", "shard"], "left_semi")


def search_stored(queries: DataFrame, store: Store, docs: DataFrame, k: int = 10, cap: int | None = 3, allowed: DataFrame | None = None) -> DataFrame:
    """Top-k chunks of ready documents by weighted BM25 over stems: (query_id, rank, chunk_id, doc_id, score).

    A query without a known term has no hits.
    """
    return _search(queries, store, docs, k, cap, allowed)[0]


def _search(queries: DataFrame, store: Store, docs: DataFrame, k: int, cap: int | None, allowed: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The hits, all blocks by query, and those of them whose postings were unpacked."""
    known, blocks = asked_blocks(store, queries)
    n, chars = _small(known)
    known = F.broadcast(known) if n <= SMALL_ROWS and chars <= SMALL_CHARS else known
    total = F.broadcast if n <= SMALL_ROWS else (lambda df: df)
    everything = known.groupBy("query_id").agg(F.sum("bound").alias("all_bounds"))

    def scores(some: DataFrame) -> DataFrame:
        rows = store.postings(some, "query_id", "idf")
        return rows.groupBy("query_id", "doc_id", "chunk_id").agg(F.sum(F.col("idf") * F.col("gain")).alias("score"))

    by_query = blocks.join(known, "term")
    # the first blocks: no more of them than lists that queries ask for
    first = _top(scores(by_query.filter("block = 0")), docs, k, cap, allowed)
    floor = written(first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).filter(F.col("n") == k).select("query_id", "floor"))
    best = F.col("all_bounds") - F.col("bound") + F.col("idf") * F.col("most")
    # sums in another order may differ in the last digits
    kept = by_query.join(total(everything), "query_id").join(total(floor), "query_id", "left").filter(F.col("floor").isNull() | (best >= F.col("floor") - 1e-9))
    whole_ids = dict(known.dtypes)["query_id"] in ("bigint", "int")
    if allowed is not None or not (n <= SMALL_ROWS and chars <= SMALL_CHARS and whole_ids):
        return _top(scores(kept), docs, k, cap, allowed), by_query, kept
    asked = known.filter("query_id IS NOT NULL").join(everything, "query_id").join(floor, "query_id", "left").select("query_id", "term", "idf", "bound", "all_bounds", "floor").toPandas()
    # what a term's best posting in a block must be worth to any of its queries
    asked["need"] = (asked["floor"].fillna(-np.inf) - asked["all_bounds"] + asked["bound"] - 1e-9) / asked["idf"]
    needs = asked.groupby("term", sort=True, as_index=False)["need"].min()
    some = blocks.join(F.broadcast(store.spark.createDataFrame(needs, "term string, need double")), "term").filter("most >= need")
    ready = docs.filter("status = 'ready' AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"))
    parts = max(int(store.spark.conf.get("spark.sql.shuffle.partitions")), store.buckets)
    dealt = some.select("term", "postings").mapInArrow(_dealt(needs["term"].tolist(), parts), _DEALT).unionByName(ready.mapInArrow(_ready(parts), _DEALT))
    found = dealt.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(_best(asked, store, k, cap), "query_id long, doc_id long, chunk_id long, score double")
    found = per_document_cap(found, cap) if cap is not None else found
    return top_per_group(found, ["query_id"], [F.desc(F.round("score", 9)), "chunk_id"], k).select("query_id", "rank", "chunk_id", "doc_id", "score"), by_query, kept


_DEALT = "part int, kind int, doc_ids array<long>, chunk_ids array<long>, terms array<int>, tf array<int>, len array<int>"
#: Stands for a null chunk id, which comes before all others too.
NO_CHUNK = np.iinfo(np.int64).min


def _part_of(doc: np.ndarray, parts: int) -> np.ndarray:
    return (((doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)


def _by_part(part, doc, chunk, *values):
    """A row for each part: its ids, sorted, as steps from one to the next, and the values."""
    order = np.lexsort((chunk, doc, part))
    part, doc, chunk = part[order], doc[order], chunk[order]
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    cuts = pa.array(np.append(first, len(part)).astype(np.int32))
    lists = []
    for x in (doc, chunk):
        steps = np.diff(x, prepend=np.int64(0))
        steps[first] = x[first]
        lists.append(pa.ListArray.from_arrays(cuts, pa.array(steps)))
    return pa.array(part[first]), lists + [pa.ListArray.from_arrays(cuts, pa.array(v[order].astype(np.int32))) for v in values]


_DEALT_NAMES = ["part", "kind", "doc_ids", "chunk_ids", "terms", "tf", "len"]


def _dealt(terms: list[str], parts: int):
    """Postings of blocks (term, postings) to a row for each part of the documents and batch; terms are numbered."""
    known = pa.array(terms, pa.string())

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("postings")
            number = pc.index_in(batch.column("term"), value_set=known).to_numpy(zero_copy_only=False)
            term = np.repeat(number, lists.value_lengths().to_numpy(zero_copy_only=False))
            doc, chunk, tf, length = lists.flatten().flatten()
            real = np.flatnonzero(doc.is_valid().to_numpy(zero_copy_only=False))
            doc, chunk = pc.fill_null(doc, 0).to_numpy()[real], pc.fill_null(chunk, NO_CHUNK).to_numpy()[real]
            part, columns = _by_part(_part_of(doc, parts), doc, chunk, term[real], tf.to_numpy()[real], length.to_numpy()[real])
            yield pa.RecordBatch.from_arrays([part, pa.array(np.ones(len(part), np.int32)), *columns], names=_DEALT_NAMES)

    return deal


def _ready(parts: int):
    """The documents that may be found, a row for each part and batch; they come before the postings."""

    def ready(batches):
        for batch in batches:
            doc = np.unique(batch.column("doc_id").to_numpy())
            none = np.zeros(len(doc), np.int64)
            part, columns = _by_part(_part_of(doc, parts), doc, none, none, none, none)
            yield pa.RecordBatch.from_arrays([part, pa.array(np.zeros(len(part), np.int32)), columns[0], *([pa.nulls(len(part), pa.list_(pa.int64()))] + [pa.nulls(len(part), pa.list_(pa.int32()))] * 3)], names=_DEALT_NAMES)

    return ready


def _places(score: np.ndarray, *group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by group and falling score, and the first and the last place of the group of each of them."""
    order = np.lexsort((-score, *group))
    new = np.ones(len(order), bool)
    new[1:] = np.any([g[order][1:] != g[order][:-1] for g in group], axis=0)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(order)))
    return order, np.repeat(first, size), np.repeat(first + size - 1, size)


def _best(asked: pd.DataFrame, store: Store, k: int, cap: int | None):
    """Rows of _dealt() and _ready(), sorted by part, to the best hits (query_id, doc_id, chunk_id, score) of each part's documents.

    Whole documents are in a part, so what a document's other chunks or better hits of the part displace
    is no hit at all.  One part is held at a time, and scored in portions of bounded cells.
    """
    queries, query = np.unique(asked["query_id"].to_numpy(np.int64), return_inverse=True)
    terms, term = np.unique(asked["term"].to_numpy(str), return_inverse=True)
    order = np.argsort(term, kind="stable")
    query, idf = query[order], asked["idf"].to_numpy(float)[order]
    start = np.searchsorted(term[order], np.arange(len(terms) + 1))
    average, k1, b = store.average, store.k1, store.b
    step = max(1, CELLS // max(1, len(queries)))

    def cut(rows):
        """Of (query, doc, chunk, score) those that may be among the hits, and each query's k-th score, 0 without.

        What another rounding may put in the place of a hit of its document stays, but doesn't count.
        """
        q, doc, _, score = rows
        counted = may = np.ones(len(q), bool)
        if cap is not None:
            order, first, last = _places(score, doc, q)
            counted, may = np.zeros((2, len(q)), bool)
            counted[order] = np.arange(len(q)) - first < cap
            may[order] = score[order] >= score[order[np.minimum(first + cap - 1, last)]] - NEAR
        at = np.flatnonzero(counted)
        order, first, _ = _places(score[at], q[at])
        least = np.zeros(len(queries))
        kth = at[order[np.arange(len(order)) - first == k - 1]]
        least[q[kth]] = score[kth]
        may = np.flatnonzero(may & (score >= least[q] - NEAR))
        return tuple(x[may] for x in rows), least

    def best(may, doc, chunk, number, tf, length):
        real = np.isin(doc, may)
        doc, chunk, number, tf, length = (x[real] for x in (doc, chunk, number, tf, length))
        order = np.lexsort((chunk, doc))
        doc, chunk, number, tf, length = (x[order] for x in (doc, chunk, number, tf, length))
        if not len(doc):
            return None
        new = np.append(True, (doc[1:] != doc[:-1]) | (chunk[1:] != chunk[:-1]))
        row, first = np.cumsum(new) - 1, np.flatnonzero(new)
        worth = gain(tf / UNIT, length / UNIT, average, k1, b)
        held, floor = None, np.zeros(len(queries))
        for low in range(0, len(first), step):
            own = slice(first[low], first[low + step] if low + step < len(first) else len(doc))
            count = start[number[own] + 1] - start[number[own]]
            at = np.repeat(start[number[own]] - np.cumsum(count) + count, count) + np.arange(count.sum())
            cell = np.repeat((row[own] - low) * len(queries), count) + query[at]
            score = np.bincount(cell, weights=np.repeat(worth[own], count) * idf[at], minlength=0)
            some = np.flatnonzero(np.bincount(cell, minlength=0))
            q = some % len(queries)
            fine = score[some] >= floor[q]
            some, q = some[fine], q[fine]
            place = first[low + some // len(queries)]
            found = (q, doc[place], chunk[place], score[some])
            held, least = cut(found if held is None else tuple(np.concatenate(x) for x in zip(held, found, strict=True)))
            floor = least - NEAR
        q, doc, chunk, score = held
        return pa.RecordBatch.from_arrays([pa.array(queries[q]), pa.array(doc), pa.array(chunk, mask=chunk == NO_CHUNK), pa.array(score)], names=["query_id", "doc_id", "chunk_id", "score"])

    def whole(rows):
        """The hits of a part's rows."""
        steps = lambda x: np.cumsum(x.values.to_numpy())
        may = [steps(r["doc_ids"]) for r in rows if not r["kind"].as_py()]
        lists = [r for r in rows if r["kind"].as_py()]
        if not may or not lists:
            return None
        plain = (np.concatenate([r[c].values.to_numpy() for r in lists]) for c in ("terms", "tf", "len"))
        return best(np.concatenate(may), *(np.concatenate([steps(r[c]) for r in lists]) for c in ("doc_ids", "chunk_ids")), *plain)

    def run(batches):
        held, part = [], None
        for batch in batches:
            for j in range(batch.num_rows):
                row = {c: batch.column(c)[j] for c in _DEALT_NAMES}
                if held and row["part"].as_py() != part:
                    found = whole(held)
                    held = []
                    if found is not None:
                        yield found
                part = row["part"].as_py()
                held.append(row)
        found = whole(held) if held else None
        if found is not None:
            yield found

    return run
