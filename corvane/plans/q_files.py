"""Round trips through files: the tables are written as files and read back by the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files as A
from .views import docs, query, scratch, table


def _corpus(spark, d) -> str:
    """Documents as text files of up to a hundred documents each, in order."""
    root = scratch(spark)
    name = F.concat_ws("-", "source", F.floor(F.col("doc_id") / 100).cast("string"))
    lines = docs(spark, d).select(name.alias("part"), "doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    A.write_text_files(lines, root, "part", ["doc_id", "place"], "line")
    return root


def _part(path: str = "source_path"):
    return F.regexp_extract(path, "part=([^/]+?)(?:/[^/]*|[.]txt)$", 1)


LINES = "SELECT source || '-' || (doc_id // 100) AS part, doc_id, i AS place, parts[i + 1] AS line FROM (SELECT source, doc_id, parts, unnest(range(0, len(parts))) AS i FROM (SELECT source, doc_id, string_split(text, chr(10)) AS parts FROM docs))"


@query("file_inventory", f"SELECT part, (sum(strlen(line) + 1))::BIGINT AS byte_size FROM ({LINES}) GROUP BY part", "docs")
def file_inventory(spark, d):
    files = A.file_inventory(spark, _corpus(spark, d))
    return files.groupBy(_part().alias("part")).agg(F.sum("byte_size").alias("byte_size"))


@query("file_fingerprint", f"SELECT part, sha256(string_agg(line || chr(10), '' ORDER BY doc_id, place)) AS content_hash, false AS rejected FROM ({LINES}) GROUP BY part", "docs")
def file_fingerprint(spark, d):
    return A.file_fingerprint(spark, _corpus(spark, d)).select(_part().alias("part"), "content_hash", "rejected")


@query("read_text_corpus", f"SELECT part, 1 AS page, md5(string_agg(line || chr(10), '' ORDER BY doc_id, place)) AS text_md5 FROM ({LINES}) GROUP BY part", "docs")
def read_text_corpus(spark, d):
    return A.read_text_corpus(spark, _corpus(spark, d)).select(_part().alias("part"), "page", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _jsonl(spark, d) -> str:
    """Items as questions, with a broken and a wrongly typed line beside each seventh."""
    path = scratch(spark)
    b = table(spark, d, "benchmark")
    good = b.select(F.to_json(F.struct(F.concat(F.lit("doc::"), F.col("item_id")).alias("chunkId"), F.col("text").alias("question"))).alias("value"))
    bad = b.filter("item_id % 7 = 0").select(F.explode(F.array(F.lit('{"chunkId": "x'), F.lit('{"chunkId": 3, "question": "y"}'))).alias("value"))
    good.unionByName(bad).write.text(path)
    return path


@query("read_jsonl_questions", "SELECT 'doc::' || item_id AS \"chunkId\", text AS question FROM benchmark")
def read_jsonl_questions(spark, d):
    return A.read_jsonl_questions(spark, _jsonl(spark, d))[0]


@query("dropped_questions", "SELECT 2 * count(*) AS dropped FROM benchmark WHERE item_id % 7 = 0")
def dropped_questions(spark, d):
    return A.read_jsonl_questions(spark, _jsonl(spark, d))[1]


def _nested(spark, d) -> tuple[DataFrame, DataFrame]:
    """Items as nested question files of up to fifty paragraphs; each third question has no answer."""
    path = scratch(spark)
    text = F.col("text")
    qa = F.struct(F.col("item_id").cast("string").alias("id"), F.concat(F.lit("which "), text).alias("question"), F.when(F.col("item_id") % 3 != 0, F.array(F.struct(text.alias("text")))).otherwise(F.array().cast("array<struct<text: string>>")).alias("answers"))
    paragraph = F.struct("item_id", F.struct(text.alias("context"), F.array(qa).alias("qas")).alias("p"))
    files = table(spark, d, "benchmark").groupBy(F.lpad(F.floor(F.col("item_id") / 50).cast("string"), 9, "0").alias("part")).agg(F.transform(F.sort_array(F.collect_list(paragraph)), lambda x: x.p).alias("paragraphs"))
    files.select("part", F.to_json(F.struct(F.array(F.struct("paragraphs")).alias("data")))).repartition("part").write.partitionBy("part").text(path)
    return A.read_nested_qa(spark, path)


NUMBERED = "SELECT item_id, text, 'qa::' || (row_number() OVER (ORDER BY item_id) - 1) AS chunk_id FROM benchmark"


@query("read_nested_qa", f"SELECT chunk_id, text FROM ({NUMBERED})")
def read_nested_qa(spark, d):
    return _nested(spark, d)[0]


@query("nested_questions", f"SELECT chunk_id, item_id::VARCHAR AS question_id, 'which ' || text AS question, text AS answer FROM ({NUMBERED}) WHERE item_id % 3 <> 0")
def nested_questions(spark, d):
    return _nested(spark, d)[1]


@query("write_report_csv", "SELECT printf('%.3f', c_acctbal) AS balance, c_name AS name, c_custkey::VARCHAR AS id, c_mktsegment || ' \"quoted\", with comma' AS segment FROM customer")
def write_report_csv(spark, d):
    path = scratch(spark)
    c = table(spark, d, "customer")
    report = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.concat("c_mktsegment", F.lit(' "quoted", with comma')).alias("segment"))
    A.write_report_csv(report, path, ["balance", "name", "id", "segment"])
    return spark.read.option("header", True).option("escape", '"').csv(path)
