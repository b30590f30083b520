"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 10).

Targets follow from the sources' sizes by filling: sources in ascending order of cap over
weight reach their cap or share the rest by weight, which is what resharing the excess until
no source is above its cap leads to.  A source whose target exceeds its size is taken whole
for each complete epoch first; the remainder is a weighted sample without replacement: each
document draws an exponential key E = -ln(u) / w, and documents are taken in ascending order of
E while the prefix sum of sizes stays within the remainder (a document that crosses it is taken
if that brings the sum nearer).

No source is ever sorted whole.  Keys are cut into bins, bin sums are prefix-summed per source,
and only the one bin in which the remainder ends is ordered, so a source with a third of all rows costs
a sort of 1/4096 of it.  u comes from a hash of id and seed: reruns agree.

Defined results: a null or empty text has size 0 and takes 0; a null source is a source of its
own, after all others; repeated rows are mixed as documents of their own; ties in E are ordered
by id and size; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .io import table, written

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BINS = 4096


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text, size):
    """Between 0 and 1: documents full of markup symbols are drawn later."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.lit(10.0) * symbols / F.greatest(size, F.lit(1))), F.lit(1.0))


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``target`` to (source, source_size), one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sizes.withColumn("weight", turn).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    filled = weighed.withColumn("level", level).withColumn("level", F.max(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))).over(every))
    return filled.select("source", "source_size", F.coalesce(F.least("cap", F.col("weight") * F.col("level")), "cap").alias("target"))


def mix_sources(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weight=None, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """Per row: id, source, ``size``, ``source_size``, ``target``, ``epochs``, ``drawn``, ``taken``.

    ``weight``: a column of positive document weights; by default quality_weight() of the text.
    ``taken`` is size * (epochs + 1 if drawn).
    """
    sized = df.select(F.col(id).alias("id"), F.col(source).alias("source"), F.col(text).alias("text"), (F.lit(None) if weight is None else weight).cast("double").alias("w")).withColumn("size", word_count(F.col("text")))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    u = (F.conv(F.substring(F.md5(name.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    keyed = sized.select("id", "source", "size", (-F.log(u) / F.coalesce("w", quality_weight(F.col("text"), F.col("size")))).alias("e"))
    docs = written(keyed.withColumn("bin", F.floor((1 - F.exp(-F.col("e"))) * BINS)))

    bins = docs.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    sources = targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, share, most)
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    sources = written(sources.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    upto = Window.partitionBy("source").orderBy("bin")
    sums = bins.withColumn("before", F.sum("bin_size").over(upto) - F.col("bin_size"))
    ends = sums.join(sources, same(sums, sources)).filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("bin_size") > F.col("rest")))
    cut = written(
        sources.join(ends.select(sums["source"].alias("cut_source"), F.col("bin").alias("cut_bin"), "before"), F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")
    )

    placed = docs.join(cut, same(docs, cut)).drop(cut["source"])
    inside = F.sum("size").over(Window.partitionBy("source").orderBy("e", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    at_cut = placed.filter(F.col("bin") == F.col("cut_bin")).withColumn("drawn", F.col("before") + inside + F.col("size") / 2 <= F.col("rest"))
    others = placed.filter(F.col("cut_bin").isNull() | (F.col("bin") != F.col("cut_bin"))).withColumn("drawn", F.coalesce(F.col("bin") < F.col("cut_bin"), F.col("rest") > 0))
    out = at_cut.unionByName(others)
    taken = F.col("size") * (F.col("epochs") + F.col("drawn").cast("long"))
    return out.select(F.col("id").alias(id), F.col("source").alias(source), "size", "source_size", "target", "epochs", "drawn", taken.alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, weights 5, 2, 1 over the sources, 150 % of the words, at most two epochs."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(length(text) - length(translate(text, '#*$%&|<>', '')), 0) AS symbols,
         (('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents),
k AS (SELECT *, -ln(u) / (1.0::DOUBLE / (1.0::DOUBLE + 10.0::DOUBLE * symbols / greatest(size, 1))) AS e FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
t AS (SELECT source, source_size, coalesce(least(cap, weight * max(CASE WHEN cap / weight > lv THEN lv END) OVER ()), cap) AS target FROM l),
p AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
x AS (SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.e, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) - k.size AS prior
      FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN prior + size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM x
"""
