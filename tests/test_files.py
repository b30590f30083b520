import os
from pathlib import Path

import pytest

from corvane.functions import text as X
from corvane.operators import relational as K
from corvane.sources import files as A

CHUNKS = "workspace_id long, doc_id long, ordinal long, text string"


def stored(spark, path):
    return sorted((r.workspace_id, r.doc_id, r.ordinal, r.text) for r in A.stored_chunks(spark, path).collect())


def test_chunks_are_stored_once(spark, tmp_path):
    path = f"file://{tmp_path}/chunks"
    first = [(1, 1, 0, "a\x00b"), (1, 1, 1, "c"), (2, 2, 0, "d")]
    assert A.write_chunks(spark.createDataFrame(first, CHUNKS), path) == 3
    assert A.write_chunks(spark.createDataFrame(first, CHUNKS), path) == 0
    more = [*first, (2, 2, 1, None), (3, 3, 0, "e")]
    assert A.write_chunks(spark.createDataFrame(more, CHUNKS), path) == 2
    assert A.write_chunks(spark.createDataFrame(more, CHUNKS), path) == 0
    want = [(1, 1, 0, "ab"), (1, 1, 1, "c"), (2, 2, 0, "d"), (2, 2, 1, None), (3, 3, 0, "e")]
    assert stored(spark, path) == want
    # another text for a stored place, or two rows for one, change nothing
    for clash in ([(4, 4, 0, "new"), (1, 1, 1, "other")], [(5, 5, 0, "x"), (5, 5, 0, "y")]):
        with pytest.raises(ValueError):
            A.write_chunks(spark.createDataFrame(clash, CHUNKS), path)
        assert stored(spark, path) == want


def test_a_batch_that_broke_off_is_repeated(spark, tmp_path):
    path = f"file://{tmp_path}/chunks"
    A.write_chunks(spark.createDataFrame([(1, 1, 0, "a")], CHUNKS), path, "one")
    # what a lost run of the batch has left is replaced, not added to
    A.write_chunks(spark.createDataFrame([(1, 2, 0, "half")], CHUNKS), path, "two")
    A.write_chunks(spark.createDataFrame([(1, 2, 0, "whole"), (1, 2, 1, "b")], CHUNKS), path, "two")
    assert stored(spark, path) == [(1, 1, 0, "a"), (1, 2, 0, "whole"), (1, 2, 1, "b")]


def test_known_files_are_not_opened(spark, tmp_path):
    root = tmp_path / "lib"
    root.mkdir()
    for i in range(6):
        (root / f"f{i}.txt").write_text(f"text {i}")
    before = A.file_fingerprint(spark, str(root)).select("source_path", "mtime", "content_hash")
    known = {r.source_path: r.content_hash for r in before.collect()}
    documents = spark.createDataFrame(before.collect(), "source_path string, mtime long, content_hash string")
    time = os.stat(root / "f0.txt").st_mtime_ns
    (root / "f0.txt").write_text("changed, but not its time")
    os.utime(root / "f0.txt", ns=(time, time))
    (root / "f1.txt").write_text("changed")
    os.utime(root / "f1.txt", ns=(time + 5 * 10**9, time + 5 * 10**9))
    (root / "f9.txt").write_text("new")
    (root / "big.txt").write_text("x" * 100)
    got = {Path(r.source_path).name: r for r in A.incremental_fingerprint(spark, str(root), documents, most=50).collect()}
    assert {n for n, r in got.items() if r.opened} == {"f1.txt", "f9.txt"}
    whole = {Path(r.source_path).name: r.content_hash for r in A.file_fingerprint(spark, str(root), most=50).collect()}
    assert all(got[n].content_hash == whole[n] for n in got if n != "f0.txt") and got["big.txt"].rejected and got["big.txt"].content_hash is None
    assert got["f0.txt"].content_hash == next(h for p, h in known.items() if p.endswith("f0.txt"))
    again = A.incremental_fingerprint(spark, str(root), A.file_fingerprint(spark, str(root)))
    assert again.filter("opened").count() == 0 and again.count() == 8


def test_compatible_forms(spark):
    rows = [(1, "ﬁle"), (2, "ＦＩＬＥ"), (3, "file"), (4, "Café ①"), (5, "Café 1"), (6, None), (7, "")]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {r.id: r.k for r in df.select("id", X.normalise_key(X.compatible("t")).alias("k")).collect()}
    assert got == {1: "file", 2: "file", 3: "file", 4: "café 1", 5: "café 1", 6: None, 7: ""}
    arrays = spark.createDataFrame([(1, ["ﬁ", None]), (2, ["a"]), (3, None)], "id long, t array<string>")
    assert {r.id: r.k for r in arrays.select("id", X.compatible_all("t").alias("k")).collect()} == {1: ["fi", None], 2: ["a"], 3: None}


def test_compatible_forms_decide(spark):
    q = spark.createDataFrame([(1, "s", ["ﬁle", "file", "x", "y"], 0, "e", [1], [1]), (2, "s", ["file", "fold", "x", "y"], 0, "e", [1], [1])], "question_id long, stem string, options array<string>, correct_index int, explanation string, source_chunk_ids array<long>, allowed_ids array<long>")
    assert {r.question_id: r.reject_reason for r in K.validate_questions(q).collect()} == {1: "options-not-distinct", 2: None}
    stems = spark.createDataFrame([(1, 1, 1, 10, "Ｗｈａｔ?"), (1, 1, 2, 11, "what"), (1, 2, 1, 12, "else")], "deck_id long, unit long, seq long, question_id long, stem string")
    assert sorted(r.question_id for r in K.dedup_stems(stems).collect()) == [10, 12]
