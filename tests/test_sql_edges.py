"""Rows at the edges of the twins' conditions, which the small tables lack."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corvane.plans import registry


@pytest.fixture
def against_sql(spark, tmp_path):
    """Runs a query and its twin on literal documents and benchmark items."""

    def run(name, texts, items=()):
        documents = {"doc_id": range(1, len(texts) + 1), "text": texts, "lang": ["en"] * len(texts), "source": ["web"] * len(texts), "n_chars": [len(t) for t in texts]}
        tables = {"documents": pa.table({c: pa.array(list(v)) for c, v in documents.items()}), "benchmark": pa.table({"item_id": pa.array(range(len(items)), pa.int64()), "text": pa.array(items, pa.string())})}
        con = duckdb.connect()
        for t, rows in tables.items():
            pq.write_table(rows, tmp_path / f"{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        df = registry.QUERIES[name](spark, str(tmp_path))
        cursor = con.execute(registry.ORACLE_SQL[name])
        names = [c[0] for c in cursor.description]
        found = sorted(tuple(r[c] for c in names) for r in df.collect())
        assert found == sorted(cursor.fetchall())
        return [dict(zip(names, r, strict=True)) for r in found]

    return run


def test_good_chunk_filter_at_the_share(against_sql):
    # 25 words of four letters and ten single ones: 110 letters of 200 characters, and one letter less
    text = " ".join(["abcd"] * 25 + ["x"] * 10)
    exact = text + "1" * (199 - len(text)) + "2"
    less = exact.replace("x", "3", 1)
    assert [r["chunk_id"] for r in against_sql("good_chunk_filter", [exact, less])] == [100000]


THEMED = ["Berge und es regnet", "Flüsse, viele", "nichts davon"]


def test_theme_documents_of_words_of_questions(against_sql):
    # the twin's themes drop stopwords only, not the words that questions about a corpus are made of
    found = against_sql("theme_documents", THEMED, ["Berge es regnet", "viele Seen"])
    assert {(r["theme_id"], r["doc_id"]) for r in found} == {(0, 1), (1, 2)}
    found = against_sql("theme_documents", THEMED, ["es Seen", "es viele"])
    assert {(r["theme_id"], r["doc_id"]) for r in found} == {(0, 1), (1, 1), (1, 2)}


def test_theme_answer_of_words_of_questions(against_sql):
    found = against_sql("theme_answer", THEMED, ["es Seen", "es viele"])
    assert {(r["theme_id"], r["doc_id"], r["n_documents"]) for r in found} == {(0, 1, 1), (1, 1, 2), (1, 2, 2)}
