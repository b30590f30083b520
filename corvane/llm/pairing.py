"""Candidate pairs between the components of rows that share a key."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .io import written

BLOCK = 2048


class Joined:
    """Labels of components that links join one after the other, for tasks in which only connections count."""

    def __init__(self, components: np.ndarray):
        _, self.of = np.unique(components, return_inverse=True)
        self.label = np.arange(self.of.max(initial=-1) + 1)

    def labels(self, rows: np.ndarray | int) -> np.ndarray:
        return self.label[self.of[rows]]

    def first(self, f: int, members: np.ndarray) -> np.ndarray:
        """Joins row ``f`` with ``members``; those of them that connect something new, one for each label."""
        own, (labels, at) = self.labels(f), np.unique(self.labels(members), return_index=True)
        new = labels != own
        if new.any():
            self.label[np.isin(self.label, labels)] = own
        return members[at[new]]


def block_pairs(nodes: DataFrame, key: str, block: int) -> DataFrame:
    """Rows (``key``, node, comp, ...) dealt to pairs (i, j) of bounded blocks of each ``key``.

    The nodes outside a key's largest component (``odd``) have to meet all others: block i of all
    its nodes meets block j of the odd ones (``probe``).  So a task holds two blocks of a key, never
    the key, and pairs inside the largest component are never formed.
    """
    sizes = nodes.groupBy(key, "comp").count().groupBy(key).agg(F.max_by("comp", F.struct("count", "comp")).alias("large"), F.max("count").alias("most"), F.sum("count").alias("all"), F.count("*").alias("comps"))
    sizes = sizes.filter("comps > 1").select(key, "large", F.ceil(F.col("all") / block).cast("int").alias("n_i"), F.ceil((F.col("all") - F.col("most")) / block).cast("int").alias("n_j"))
    met = nodes.join(sizes, key).withColumn("odd", F.col("comp") != F.col("large")).withColumn("hash", F.hash("node"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = met.withColumns({"i": F.pmod("hash", "n_i"), "probe": F.lit(False)}).withColumn("j", every("n_j"))
    odd = met.filter("odd").withColumns({"j": F.pmod("hash", "n_j"), "probe": F.lit(True)}).withColumn("i", every("n_i"))
    return own.unionByName(odd).drop("large", "n_i", "n_j", "hash")


def block_edges(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows by ``columns`` (the first counts most) and where the runs equal in all but the last begin."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(max(len(order) - 1, 0), bool)
    for c in columns[:-1]:
        new |= np.diff(c[order]) != 0
    return order, np.flatnonzero(np.concatenate(([True], new, [True])))


def _across(payload: tuple[str, ...], judge: Callable, connect: bool):
    def across(rows: pa.Table) -> pa.Table:
        columns = {c: (rows[c].to_pylist() if pa.types.is_binary(rows.schema.field(c).type) else rows[c].to_numpy()) for c in payload}
        key, node, comp, i, j, odd, probe = (rows[c].to_numpy() for c in ("key", "node", "comp", "i", "j", "odd", "probe"))
        order, edges = block_edges(key, i, j, node)
        pairs = set()
        joined = Joined(comp)
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            at = order[x:y]
            members = at[~probe[at]]
            for f in at[probe[at]]:
                m = members[(joined.labels(members) != joined.labels(f)) & (~odd[members] | (node[members] < node[f]))]
                if len(m):
                    m, _ = judge(columns, f, m)
                    if connect and len(m):
                        m = joined.first(f, m)
                    one = int(node[f])
                    pairs |= {(min(one, o), max(one, o)) for o in node[m].tolist()}
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return across


def cross_component_pairs(active: DataFrame, components: DataFrame, node: str, payload: tuple[str, ...], judge: Callable, extra: DataFrame | None = None, connect: bool = False) -> DataFrame:
    """Distinct pairs (a, b) of nodes that share a key, lie in different components and pass ``judge``.

    ``judge(columns, f, members)`` returns the members that may be linked to row f, and scores.
    With ``connect``, a task leaves out pairs whose components its other pairs have joined already: the
    same components follow, from no more pairs than rows, whatever the number of components of a key.

    ``active``: (key, node, ...); ``extra``: a table of further payload by node.
    """
    own = [c for c in payload if c in active.columns]
    nodes = active.select("key", F.col(node).alias("node"), *own).join(components.select("node", F.col("component").alias("comp")), "node", "left")
    split = block_pairs(nodes.withColumn("comp", F.coalesce("comp", "node")), "key", BLOCK)
    if extra is not None:
        split = split.join(extra.withColumnRenamed(node, "node"), "node")
    left = written(split.select("key", "node", "comp", "i", "j", "odd", "probe", *payload))
    groups = max(512, left.count() // 8192)
    return left.groupBy(F.pmod(F.xxhash64("key", "i", "j"), F.lit(groups))).applyInArrow(_across(payload, judge, connect), "a long, b long").distinct()
