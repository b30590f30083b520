"""Many small text files: one a part, in few folders, with the bytes that Spark's own writer gives."""

import os
from pathlib import Path

from pyspark.sql import functions as F

from corvane.sources import files as A


def test_files_of_parts(spark, tmp_path):
    rows = [(f"src-{i % 700}", i, 0, f"line {i} ä\r") for i in range(3000)] + [("src-3", 1, 1, ""), ("a b", 0, 0, "x")]
    df = spark.createDataFrame(rows, "part string, doc long, place int, line string").repartition(7)
    A.write_text_files(df, f"file://{tmp_path}/new", "part", ["doc", "place"], "line")
    df.repartition("part").sortWithinPartitions("part", "doc", "place").select("part", "line").write.partitionBy("part").text(f"file://{tmp_path}/old")
    name = F.regexp_extract("source_path", "part=([^/]+?)(?:/[^/]*|[.]txt)$", 1)
    new, old = ({r.part: r.text for r in A.read_text_corpus(spark, f"file://{tmp_path}/{x}").select(name.alias("part"), "text").collect()} for x in ("new", "old"))
    assert len(new) == 701 and new == old
    assert sum(len(d) for _, d, _ in os.walk(tmp_path / "new")) <= A.FOLDERS and not list(Path(tmp_path / "new").rglob(".*"))


def test_names_that_are_no_file_names(spark, tmp_path):
    df = spark.createDataFrame([("a/b", 0, "x"), ("c", 0, "y")], "part string, doc long, line string")
    A.write_text_files(df, f"file://{tmp_path}/odd", "part", ["doc"], "line")
    assert sorted(r.text for r in A.read_text_corpus(spark, f"file://{tmp_path}/odd").collect()) == ["x\n", "y\n"]
