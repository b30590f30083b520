"""File inventory, text and dataset readers, report writers."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import CODE_EXTENSIONS
from .shared import written

# What is read, and up to which size.
EXTENSIONS = ("pdf", "docx", "md", "markdown", "txt", "rst", *CODE_EXTENSIONS)
TEXT_EXTENSIONS = ("md", "markdown", "txt", "rst", *CODE_EXTENSIONS)
MOST_BYTES = 50 * 1024 * 1024


def _files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def _relative(root: str):
    """The part of ``path`` below the root."""
    bare = root.split("://")[-1].rstrip("/")
    return F.substring_index("path", bare + "/", -1)


def _supported(root: str, extensions=EXTENSIONS):
    parts = F.split(_relative(root), "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") | (p == "node_modules"))
    return F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions) & ~hidden


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """(source_path, byte_size, mtime) of supported files; hidden ones and node_modules are left out.

    File contents are not read: only the listing's columns are selected.
    """
    return _files(spark, root).filter(_supported(root)).select(F.col("path").alias("source_path"), F.col("length").alias("byte_size"), F.unix_millis("modificationTime").alias("mtime"))


def file_fingerprint(spark: SparkSession, root: str, most: int = MOST_BYTES) -> DataFrame:
    """Adds ``content_hash`` (sha256); files over ``most`` bytes are reported without one and not read."""
    small = _files(spark, root).filter(_supported(root) & (F.col("length") <= most))
    hashed = small.select(F.col("path").alias("source_path"), F.sha2("content", 256).alias("content_hash"))
    return file_inventory(spark, root).join(hashed, "source_path", "left").withColumn("rejected", F.col("byte_size") > most)


def incremental_fingerprint(spark: SparkSession, root: str, documents: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """file_fingerprint() of a tree of which ``documents`` (source_path, mtime, content_hash) are known.

    A file with the path and time of a known document keeps its hash and isn't opened; only the
    paths of the others, which the listing holds on the driver anyway, are read.  Adds ``opened``.
    """
    inventory = written(file_inventory(spark, root))
    known = documents.filter(F.col("content_hash").isNotNull()).select("source_path", "mtime", "content_hash").dropDuplicates(["source_path", "mtime"])
    listed = written(inventory.join(known, ["source_path", "mtime"], "left").withColumn("rejected", F.col("byte_size") > most))
    changed = [r[0] for r in listed.filter("content_hash IS NULL AND NOT rejected").select("source_path").collect()]
    if not changed:
        return listed.withColumn("opened", F.lit(False)).select("source_path", "byte_size", "mtime", "content_hash", "rejected", "opened")
    read = spark.read.format("binaryFile").load(changed).select(F.col("path").alias("source_path"), F.sha2("content", 256).alias("_hash"), F.lit(True).alias("_opened"))
    out = listed.join(read, "source_path", "left")
    return out.select("source_path", "byte_size", "mtime", F.coalesce("content_hash", "_hash").alias("content_hash"), "rejected", F.coalesce("_opened", F.lit(False)).alias("opened"))


def text_files(files: DataFrame, root: str) -> DataFrame:
    """(source_path, page, text) of the supported text files of a binary listing, which may be a stream."""
    kept = files.filter(_supported(root, TEXT_EXTENSIONS) & (F.col("length") <= MOST_BYTES))
    return kept.select(F.col("path").alias("source_path"), F.lit(1).alias("page"), F.regexp_replace(F.expr("decode(content, 'UTF-8')"), "^\\uFEFF", "").alias("text"))


def read_text_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(source_path, page, text): UTF-8 text files, byte order mark stripped, one page each."""
    return text_files(_files(spark, root), root)


#: Folders over which write_text_files() deals its files, so that none holds them all and few have to be listed.
FOLDERS = 256


def _write_files(root: str, name: str, line: str):
    """Runs of rows of one name to a file each, which appears under its name when it is whole."""

    def place(value: str) -> tuple[str, str]:
        folder, _, part = value.partition("/")
        folder = f"{root}/{folder}"
        os.makedirs(folder, exist_ok=True)
        return f"{folder}/.{uuid.uuid4().hex}", f"{folder}/part={part}.txt"

    def write(batches):
        now, out, at, files = None, None, None, 0
        for batch in batches:
            lines = batch.column(line).to_pylist()
            runs = pa.compute.run_end_encode(batch.column(name))
            start = 0
            for value, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if value != now:
                    if out:
                        out.close()
                        os.replace(*at)
                    now, at, files = value, place(value), files + 1
                    out = open(at[0], "wb")
                out.write(("\n".join(lines[start:end]) + "\n").encode())
                start = end
        if out:
            out.close()
            os.replace(*at)
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    return write


def write_text_files(lines: DataFrame, root: str, part: str, order: list[str], line: str) -> None:
    """The lines of each ``part``, by ``order``, as one text file below ``root``, with ``part=<name>`` in its path.

    Spark's writer makes a folder a file, and on a file system without native Hadoop a process a file
    (to set its permissions), so tasks write the files of a ``file:`` root themselves: to a hidden name first,
    so that a repeated task replaces what it left.  Other roots are written by Spark.
    """
    spark = lines.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    plain = F.col(part).rlike("^[^/\\x00-\\x1F%\"#'*:=?\\\\{\\[\\]^]{1,60}$")
    if urlparse(whole).scheme != "file" or lines.filter(~F.coalesce(plain, F.lit(False))).limit(1).count():
        lines.repartition(part).sortWithinPartitions(part, *order).select(part, line).write.partitionBy(part).text(root)
        return
    folder = F.concat(F.lpad(F.pmod(F.hash(part), F.lit(FOLDERS)).cast("string"), 3, "0"), F.lit("/"), part)
    rows = lines.repartition(part).sortWithinPartitions(part, *order).select(folder.alias("name"), F.col(line).alias("line"))
    rows.mapInArrow(_write_files(unquote(urlparse(whole).path), "name", "line"), "files long").agg(F.sum("files")).first()


def read_jsonl_questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(questions (chunkId, question), count of malformed or wrongly typed lines)."""
    rows = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    parsed = F.from_json("value", "chunkId string, question string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    typed = F.col("value").rlike(r'"chunkId"\s*:\s*"') & F.col("value").rlike(r'"question"\s*:\s*"')
    out = rows.withColumn("q", parsed).withColumn("ok", typed & F.col("q._bad").isNull() & F.col("q.chunkId").isNotNull() & F.col("q.question").isNotNull())
    return out.filter("ok").select("q.chunkId", "q.question"), out.agg(F.count_if(~F.col("ok")).alias("dropped"))


NESTED_QA = "data array<struct<paragraphs: array<struct<context: string, qas: array<struct<id: string, question: string, answers: array<struct<text: string>>>>>>>>"


def read_nested_qa(spark: SparkSession, path: str, prefix: str = "qa") -> tuple[DataFrame, DataFrame]:
    """(chunks, questions) of nested question files; questions without an answer are dropped."""
    raw = spark.read.schema(NESTED_QA).option("multiLine", "true").json(path).withColumn("file", F.input_file_name())
    paragraphs = raw.select("file", F.posexplode("data").alias("a", "d")).select("file", "a", F.posexplode("d.paragraphs").alias("b", "p"))
    # numbered inside each file, then on from the paragraphs of the files before it: one row a file
    inside = F.row_number().over(Window.partitionBy("file").orderBy("a", "b")) - 1
    sizes = paragraphs.groupBy("file").agg(F.count("*").alias("size"))
    before = sizes.select("file", (F.sum("size").over(Window.orderBy("file")) - F.col("size")).alias("before"))
    n = F.col("inside") + F.col("before")
    numbered = paragraphs.withColumn("inside", inside).join(before, "file").withColumn("chunk_id", F.concat(F.lit(f"{prefix}::"), n.cast("string")))
    questions = numbered.select("chunk_id", F.explode("p.qas").alias("q")).filter(F.size("q.answers") > 0).select("chunk_id", F.col("q.id").alias("question_id"), "q.question", F.element_at("q.answers.text", 1).alias("answer"))
    return numbered.select("chunk_id", F.col("p.context").alias("text")), questions


def without_nul(c):
    return F.regexp_replace(c, "\\u0000", "")


def clean_chunks(chunks: DataFrame) -> DataFrame:
    out = chunks.withColumn("text", without_nul(F.col("text")))
    return out.withColumn("heading_path", F.transform("heading_path", without_nul)) if "heading_path" in chunks.columns else out


def duplicate_ordinals(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id", "ordinal").agg(F.count("*").alias("n")).filter("n > 1")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def stored_chunks(spark: SparkSession, path: str) -> DataFrame | None:
    """What write_chunks() has stored below ``path``, with the ``batch`` each row came with; None if nothing."""
    return spark.read.option("mergeSchema", "true").parquet(path) if _exists(spark, path) else None


def write_chunks(chunks: DataFrame, path: str, batch: str | None = None) -> int:
    """Appends chunks without NUL characters by workspace; returns how many were new.

    A (workspace_id, doc_id, ordinal) is stored once: rows that are stored already, with the same
    values, are left out, and other values for it, in the new rows or against stored ones, are an
    error before anything is written.  A batch owns the folder of its name, so repeating a batch that
    broke off replaces what it left.  Only the partitions of the new rows' workspaces are read.
    """
    spark = chunks.sparkSession
    clean = clean_chunks(chunks)
    if duplicate_ordinals(clean).limit(1).count():
        raise ValueError("a document has two chunks with one ordinal")
    keys = ["workspace_id", "doc_id", "ordinal"]
    name = batch or uuid.uuid4().hex
    stored = stored_chunks(spark, path)
    new = clean
    if stored is not None:
        values = [c for c in clean.columns if c not in keys and c in stored.columns]
        known = stored.filter(F.col("batch").cast("string") != name).select(*keys, F.struct(*values).alias("_stored"))
        compared = written(clean.join(known.withColumn("_known", F.lit(True)), keys, "left").withColumn("_same", F.struct(*values).eqNullSafe(F.col("_stored"))).drop("_stored"))
        if compared.filter("_known AND NOT _same").limit(1).count():
            raise ValueError("a stored chunk has other values")
        new = compared.filter("_known IS NULL").drop("_known", "_same")
    new = written(new)
    n = new.count()
    new.write.mode("overwrite").partitionBy("workspace_id").parquet(f"{path}/batch={name}")
    return n


def write_report_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed column order, doubled quotes, numbers with three decimals."""
    kinds = dict(df.dtypes)
    shown = [F.format_string("%.3f", F.col(c).cast("double")).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns]
    df.select(*shown).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def document_text(chunks: DataFrame) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("ordinal", "text")))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda x: x.text), "\n\n").alias("text"))


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """First 16 hex digits of a hash of the rows in any order: (fingerprint, n).

    Rows are hashed and their hashes added up by 13-digit pieces, so no task holds the dataset.
    """
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    piece = lambda i: F.sum(F.conv(F.substring(h, 1 + 13 * i, 13), 16, 10).cast("decimal(38,0)"))
    sums = df.agg(*(piece(i).alias(f"s{i}") for i in range(4)), F.count("*").alias("n"))
    return sums.select(F.substring(F.sha2(F.concat_ws(":", *(F.col(f"s{i}").cast("string") for i in range(4)), F.col("n").cast("string")), 256), 1, 16).alias("fingerprint"), "n")
