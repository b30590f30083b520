import datetime as dt
import json
import os
import random
import re
from pathlib import Path

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.operators.chunking import chunk_fixed
from corvane.sources import files as A
from corvane.streaming import jobs as N

T0 = dt.datetime(2024, 1, 1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "<", "think>", "</think>", "<think>", "/"]), max_size=12), st.integers(1, 4))
def test_think_filter_equals_the_whole_text(parts, cut):
    import re

    text = "".join(parts)
    held, inside, out = "", False, ""
    for i in range(0, len(text), cut):
        piece, held, inside = N.think_step(held, inside, text[i : i + cut])
        out += piece
    out += "" if inside else held
    assert out == re.sub(r"(?s)<think>.*?(?:</think>|\Z)", "", text)


def test_loops():
    tail = "this sentence is repeated again and again "[-40:]
    assert N.loops(tail * 3) and not N.loops(tail * 2) and not N.loops("-" * 400) and not N.loops("")


def read_stream(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_counters_and_activity_equal_their_batch(spark, tmp_path):
    rows = [(i % 3, 1 if i % 4 else -1, 10) for i in range(20)]
    schema = "doc_id long, chunks long, tokens long"
    stream = run(N.counter_stream(read_stream(spark, rows, schema, str(tmp_path / "a"))), "counters", "complete")
    assert set(stream.collect()) == set(N.counter_stream(spark.createDataFrame(rows, schema)).collect())
    rows = [(i % 4, i) for i in range(12)]
    stream = run(N.conversation_activity(read_stream(spark, rows, "conv_id long, created_at long", str(tmp_path / "b"))), "activity", "complete")
    assert set(stream.collect()) == set(N.conversation_activity(spark.createDataFrame(rows, "conv_id long, created_at long")).collect())


def test_debounce_in_stream_and_batch(spark, tmp_path):
    at = lambda ms: T0 + dt.timedelta(milliseconds=ms)
    rows = [(1, at(0)), (1, at(500)), (1, at(2000)), (2, at(100)), (1, at(10**7))]
    schema = "workspace_id long, ts timestamp"
    batch = {(r.workspace_id, r.changes) for r in N.debounce_changes(spark.createDataFrame(rows, schema)).collect()}
    assert batch == {(1, 2), (1, 1), (2, 1)}
    stream = run(N.debounce_changes(read_stream(spark, rows, schema, str(tmp_path / "c")), late="1 minute"), "bursts")
    assert {(r.workspace_id, r.changes) for r in stream.collect()} <= batch and stream.count() >= 3


def test_stage_pairs(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(1, "embed", "start", at(0)), (1, "embed", "done", at(3)), (2, "rank", "done", at(1)), (3, "rank", "start", at(0)), (3, "rank", "start", at(4)), (3, "rank", "done", at(6)), (3, "rank", "done", at(900))]
    schema = "stream_id long, stage string, state string, ts timestamp"
    want = {(1, "embed", 3000), (3, "rank", 2000), (3, "rank", 896000)}
    got = lambda df: {(r.stream_id, r.stage, r.duration_ms) for r in df.collect()}
    assert got(N.stage_durations(spark.createDataFrame(rows, schema))) == want
    assert got(N.stage_durations(spark.createDataFrame(rows, schema), 10_000)) == want - {(3, "rank", 896000)}
    # the watermark passes the last event when a later one of another stream comes
    rows.append((9, "rank", "start", at(90000)))
    assert got(run(N.stream_stage_durations(read_stream(spark, rows, schema, str(tmp_path / "d"))), "stages")) == want


def test_file_ingest(spark, tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    (root / "a.txt").write_text("hello world")
    (root / "b.bin").write_bytes(b"x")
    out = str(tmp_path / "chunks")
    N.stream_file_ingest(spark, str(root), lambda b: chunk_fixed(b, "source_path", "text", 6, 0), out, str(tmp_path / "ck")).awaitTermination(120)
    (root / "c.md").write_text("later")
    N.stream_file_ingest(spark, str(root), lambda b: chunk_fixed(b, "source_path", "text", 6, 0), out, str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(r.chunk_text for r in spark.read.parquet(out).collect()) == ["hello", "later", "world"]


def test_backfill_stops_without_progress(spark, tmp_path):
    schema = "chunk_id long, embedding array<double>"
    for i in range(5):
        spark.createDataFrame([(i, None), (10 + i, [2.0])], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen, tried = [], []
    sink = lambda df, batch: seen.extend(r.chunk_id for r in df.collect())

    def silent(df):
        tried.append(1)
        return df

    N.stream_backfill(stream(), silent, sink, str(tmp_path / "ck1")).awaitTermination(120)
    assert not seen and len(tried) == 2
    fill = lambda df: df.withColumn("embedding", F.array(F.lit(1.0)))
    N.stream_backfill(stream(), fill, sink, str(tmp_path / "ck2")).awaitTermination(120)
    assert sorted(seen) == [0, 1, 2, 3, 4]
    spark.createDataFrame([(7, None)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    N.stream_backfill(stream(), fill, sink, str(tmp_path / "ck2")).awaitTermination(120)
    assert sorted(seen) == [0, 1, 2, 3, 4, 7]


def test_stream_reconcile_takes_settled_workspaces(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    changes = read_stream(spark, [(1, at(0)), (2, at(5)), (3, at(10**5))], "workspace_id long, ts timestamp", str(tmp_path / "f"))
    inventory = spark.createDataFrame([(w, "/r/a.txt", "h", 1) for w in (1, 2, 3)], "workspace_id long, source_path string, content_hash string, mtime long")
    documents = spark.createDataFrame([(w, "/r/a.txt", "old", 0, None) for w in (1, 2, 3)], "workspace_id long, source_path string, content_hash string, mtime long, missing_at long")
    got = []
    N.stream_reconcile(changes, lambda: inventory, lambda: documents, lambda df: got.extend((r.workspace_id, r.action) for r in df.collect()), str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(got) == [(1, "reindexed"), (2, "reindexed")]


def test_reader_and_writer(spark, tmp_path):
    root = tmp_path / "lib"
    (root / "node_modules").mkdir(parents=True)
    (root / ".git").mkdir()
    for name, data in {"a.md": b"\xef\xbb\xbfhi", "b.pdf": b"%PDF", "c.exe": b"x", ".git/d.txt": b"x", "node_modules/e.js": b"x"}.items():
        (root / name).write_bytes(data)
    names = lambda df: sorted(r.source_path.rsplit("/", 1)[1] for r in df.collect())
    assert names(A.file_inventory(spark, str(root))) == ["a.md", "b.pdf"]
    prints = A.file_fingerprint(spark, str(root), most=3).collect()
    assert {r.source_path[-4:]: r.rejected for r in prints} == {"a.md": True, ".pdf": True} or all(r.rejected for r in prints)
    assert A.read_text_corpus(spark, str(root)).first().text == "hi"
    (tmp_path / "q.jsonl").write_text('{"chunkId": "a::1", "question": "x?"}\n{bad\n{"chunkId": 3, "question": "y"}\n')
    good, dropped = A.read_jsonl_questions(spark, str(tmp_path / "q.jsonl"))
    assert good.count() == 1 and dropped.first().dropped == 2
    (tmp_path / "n.json").write_text('{"data": [{"paragraphs": [{"context": "c", "qas": [{"id": "1", "question": "q", "answers": [{"text": "t"}]}, {"id": "2", "question": "r", "answers": []}]}]}]}')
    chunks, questions = A.read_nested_qa(spark, str(tmp_path / "n.json"))
    assert chunks.first().chunk_id == "qa::0" and questions.count() == 1
    A.write_report_csv(spark.createDataFrame([("a\"b", 1.23456)], "name string, x double"), str(tmp_path / "csv"), ["x", "name"])
    assert 'x,name' in "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv")) and '1.235,"a""b"' in "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))


def test_think_stream(spark, tmp_path):
    rows = [(1, 0, "a<th", False), (1, 1, "ink>no</think", False), (1, 2, ">b", True)]
    schema = "stream_id long, seq long, piece string, last boolean"
    out = run(N.filter_think_stream(read_stream(spark, rows, schema, str(tmp_path / "e"))), "thoughts")
    assert "".join(r.text for r in out.orderBy("seq").collect()) == "ab"


def batches(spark, parts, schema, folder):
    """A stream that reads each of the lists of rows as a batch of its own, in order."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        for f in Path(folder).glob("part-*"):
            if f.name.startswith("part-"):
                f.rename(f.with_name(f"b{k:03d}-{f.name[5:]}"))
                os.utime(f.with_name(f"b{k:03d}-{f.name[5:]}"), (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drained(df, name, checkpoint):
    """Rows of the stream, and rows of state left at its end."""
    df.sparkSession.conf.set("spark.sql.shuffle.partitions", "1")
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(180)
    df.sparkSession.conf.set("spark.sql.shuffle.partitions", "4")
    left = [p["stateOperators"][0]["numRowsTotal"] for p in map(json.loads, (p.json for p in q.recentProgress)) if p["stateOperators"]]
    return df.sparkSession.table(name).collect(), left


PIECES = "stream_id long, seq long, piece string, last boolean, ts timestamp"


def test_think_and_loops_over_random_splits(spark, tmp_path):
    rng = random.Random(12)
    again = "noch einmal derselbe Satz, Wort für Wort, "
    texts = {
        1: "vorher <think>" + "geheim " * 20 + "</think>nachher",
        2: "a<b <thin <think>x</think> y",
        3: again * 6,
        4: "kein Ende <think>offen",
        5: "abgebrochen <thi",
        6: "ganz normal " * 3 + "-" * 500,
    }
    pieces = {}
    for i, text in texts.items():
        cuts = sorted(rng.sample(range(1, len(text)), min(9, len(text) - 1)))
        pieces[i] = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(i, k, p, i not in (4, 5) and k == len(ps) - 1, at(k)) for i, ps in pieces.items() for k, p in enumerate(ps)]
    parts = [[r for r in rows if r[1] // 2 == b] for b in range(5)]
    # long after, another stream lets the watermark pass the idle ones
    parts += [[(99, 0, "x", False, at(1000))], [(99, 1, "y", True, at(1001))]]
    plain = {i: re.sub(r"(?s)<think>.*?(?:</think>|\Z)", "", t) for i, t in texts.items()}
    found, left = drained(N.filter_think_stream(batches(spark, parts, PIECES, str(tmp_path / "in"))), "filtered", str(tmp_path / "c1"))
    shown = {}
    for r in sorted(found, key=lambda r: r.seq):
        shown[r.stream_id] = shown.get(r.stream_id, "") + r.text
    assert {i: shown.get(i, "") for i in texts} == plain
    assert left[-1] == 0 and max(left) <= 3 * 7
    first = {}
    for i, ps in pieces.items():
        trip = next((k for k in range(len(ps)) if N.loops("".join(ps[: k + 1]))), None)
        if trip is not None:
            first[i] = trip
    found, left = drained(N.detect_loops_stream(spark.readStream.schema(PIECES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))), "looped", str(tmp_path / "c2"))
    assert {r.stream_id: r.seq for r in found} == first and 3 in first and len(found) == len(first) and left[-1] == 0


def test_stage_clock_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    at = lambda s: T0 + dt.timedelta(seconds=s)
    events = [(i % 3, "embed" if i % 2 else "rank", rng.choice(["start", "done", "other"]), at(rng.randrange(0, 2000))) for i in range(150)]
    order = sorted(events, key=lambda e: e[3])
    # shuffled within five minutes: nothing is later than the watermark allows
    order = [e for _, _, e in sorted((e[3] + dt.timedelta(seconds=rng.randrange(0, 300)), k, e) for k, e in enumerate(order))]
    parts = [order[k : k + 25] for k in range(0, len(order), 25)] + [[(77, "rank", "other", at(10**5))], [(77, "rank", "other", at(10**5 + 1))]]
    schema = "stream_id long, stage string, state string, ts timestamp"
    got, left = drained(N.stream_stage_durations(batches(spark, parts, schema, str(tmp_path / "in")), 200_000, "10 minutes"), "clock", str(tmp_path / "c"))
    want = N.stage_durations(spark.createDataFrame(events, schema), 200_000).collect()
    key = lambda rows: sorted((r.stream_id, r.stage, r.done_at, r.duration_ms) for r in rows)
    assert key(got) == key(want) and want
    # neither events nor starts stay
    assert left[-1] == 0
