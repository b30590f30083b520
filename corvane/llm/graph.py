"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .io import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node of the component of every node on an edge.

    Each round hooks every node to the smallest neighbour and flattens the result; the
    number of rounds is logarithmic in the longest path.  Only edges are shuffled and every
    minimum is combined before the shuffle, so a node with very many edges is no problem.
    Each round is written to the shared folder.  Loops and nulls are dropped.
    """
    now = written(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v").distinct())
    before = _state(now)
    if not before[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(rounds):
        now = written(_small_star(_large_star(now)).distinct())
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def merge_components(components: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after further links (a, b) between nodes, known ones or new."""
    of = lambda c: components.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = connected_components(ends).withColumnRenamed("component", "to").withColumnRenamed("node", "component")
    old = components.join(joined, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    new = joined.join(components.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("to").alias("component"))
    return written(old.unionByName(new))
