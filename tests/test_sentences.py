"""Sentences put together again give their texts, whatever white space they have, as in SQL."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from corvane.operators import chunking as C
from corvane.plans import registry


def test_odd_white_space_empty_texts_and_rows_that_share_an_id(spark, tmp_path):
    rng = random.Random(3)
    parts = ["One", "two", ".", "! ", " ", "\n", "\t", "\r", " ", "　", " ", "\x1c", "?)", ",", "é" * 30, "word " * 170, "", "…"]
    texts = ["", " ", "\n", " \n\t", "\t", "a.\tb", "a. b.", " a. b 　", "a\r\nb\r", None]
    texts += ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(400)]
    ids = [None if i % 50 == 7 else i // 3 for i in range(len(texts))]
    table = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * len(ids), "source": ["web"] * len(ids), "n_chars": [0] * len(ids)})
    pq.write_table(table, tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.execute(registry.ORACLE_SQL["reassemble_sentences"]).fetchall()
    got = [(r.doc_id, r.text_md5) for r in registry.QUERIES["reassemble_sentences"](spark, str(tmp_path)).collect()]
    assert len(want) > 200 and sorted(got, key=str) == sorted(want, key=str)


def test_sentences_are_trimmed_and_gaps_are_kept(spark):
    df = spark.createDataFrame([(1, " One.\tTwo! \nThree"), (2, ""), (3, None)], "doc_id long, text string")
    rows = [(r.doc_id, r.block, r.seq, r.sentence, r.sep) for r in C.segment_sentences(df).collect()]
    assert rows == [(1, 0, 0, "One.", None), (1, 0, 1, "Two!", "\t"), (1, 1, 0, None, "\n"), (1, 2, 0, "Three", None), (2, 0, 0, "", None)]
    assert "".join(g + s for g, s in C.sentence_parts("a  b\tc " * 300)) == "a  b\tc " * 300
    assert all(len(s) <= C.SENTENCE_MOST for s in C.sentences_of("a  b\tc " * 300))
