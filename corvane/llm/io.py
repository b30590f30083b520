"""Reading the tables and keeping intermediate results where every executor sees them."""

from __future__ import annotations

import tempfile
import uuid
import weakref

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A local master may leave it unset (tests): then a temporary folder of this machine is made
    and kept in the session's settings.  On a cluster it has to be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("corvane.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="corvane-checkpoint-")
        spark.conf.set("corvane.checkpoint.dir", folder)
    return folder


#: Where the tables written here stand, as long as their frames live.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once as a table in the shared folder and read back.

    This cuts the lineage: a lost executor costs a read of the table, not a new computation.
    """
    path = f"{shared_folder(df.sparkSession)}/corvane-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[back] = path
    return back


def discard(df: DataFrame) -> None:
    """Frees the table behind a frame of written() that nothing reads any more: an empty one takes its place."""
    path = _PATHS.pop(df, None)
    if path:
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]
        df.sparkSession.range(0, 0, 1, 1).select(*none).write.mode("overwrite").parquet(path)


def crc_mod(column, modulus: int):
    """crc32 of the id written as text, modulo ``modulus``."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus))


def sampled_labels(docs: DataFrame, labels: DataFrame, label: str, sample: int, text: str = "text") -> DataFrame:
    """(doc_id, label) of at most ``sample`` documents of each of the labels 0 and 1.

    The first by a hash of the id are taken, so the choice does not depend on the run.  Only ids
    are shuffled; the result has at most 2 * ``sample`` rows, which bounds what a join with the
    texts has to broadcast.
    """
    one = labels.filter(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias(label)).withColumn("h", F.xxhash64("doc_id", F.lit(11)))
    known = one.join(docs.filter(F.col(text).isNotNull()).select("doc_id").distinct(), "doc_id", "left_semi")
    picked = [known.filter(F.col(label) == y).orderBy("h", "doc_id").limit(sample).select("doc_id", label) for y in (0, 1)]
    return written(picked[0].unionByName(picked[1]))


def membership(df: DataFrame, column, bits: int) -> np.ndarray:
    """Bitmap of the values (low bits of a long column) that occur: a filter of fixed size.

    It is built by Spark and has bits / 8 bytes whatever the input, so tasks may hold it.  It
    only ever thins out what an exact join then decides.
    """
    x = df.select(column.bitwiseAND(bits - 1).alias("x"))
    words = x.groupBy(F.shiftright("x", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x & 63 as int))")).alias("v")).toArrow()
    member = np.zeros(max(bits // 64, 1), np.uint64)
    member[words["w"].to_numpy()] = words["v"].to_numpy().view(np.uint64)
    return member


def in_membership(member: np.ndarray, values: np.ndarray) -> np.ndarray:
    low = values.view(np.uint64) & np.uint64(64 * len(member) - 1)
    return ((member[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1)).astype(bool)
