"""Event-driven corpus jobs.

Each job is a DataFrame function that works on a stream and on a table alike, or a batch twin
next to the stream.  Watermarks are a choice of this library: late events beyond them are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.maintenance import reconcile_inventory
from ..sources.files import text_files
from .keyed import LOOP_TAIL, LOOP_TIMES, LOOP_WINDOW, detect_loops_stream, filter_think_stream, loops, stream_stage_durations, think_step

DEBOUNCE = "800 milliseconds"


def debounce_changes(changes: DataFrame, gap: str = DEBOUNCE, late: str | None = None) -> DataFrame:
    """One row for each burst of a workspace's changes (workspace_id, ts) that ``gap`` of silence ends."""
    if late is not None:
        changes = changes.withWatermark("ts", late)
    bursts = changes.groupBy("workspace_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("changes"))
    return bursts.select("workspace_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "changes")


def stream_file_ingest(spark: SparkSession, root: str, chunk: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """New text files are read, chunked by ``chunk`` and stored; runs until all present files are in.

    The rules are those of read_text_corpus(): hidden files, node_modules and files over 50 MiB are left
    out, byte order marks go.  Each batch owns a folder named by its id, which a retry overwrites, so no
    file is stored twice.
    """
    schema = spark.read.format("binaryFile").load(root).schema
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)
    texts = text_files(files, root).select("source_path", "text")

    def store(batch: DataFrame, batch_id: int) -> None:
        chunk(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return texts.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_reconcile(changes: DataFrame, inventory: Callable[[], DataFrame], documents: Callable[[], DataFrame], sink: Callable[[DataFrame], None], checkpoint: str):
    """Reconciles the workspaces whose changes came to rest; one micro-batch after the other."""

    def run(batch: DataFrame, _: int) -> None:
        touched = batch.select("workspace_id").distinct()
        keep = lambda df: df.join(touched, "workspace_id", "left_semi")
        sink(reconcile_inventory(keep(inventory()), keep(documents())))

    return debounce_changes(changes, late="1 minute").writeStream.foreachBatch(run).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_backfill(chunks: DataFrame, embed: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, idle: int = 2):
    """Rows of the stream ``chunks`` without a vector are embedded and handed to ``sink`` with the batch's id.

    The checkpoint remembers what was read, so a later run goes on with new rows and none is scanned
    again.  After ``idle`` batches in a row that brought no vector, the rest of the run is passed by: the
    model is out of reach, and a new checkpoint takes these rows up again.
    """
    still = 0

    def fill(batch: DataFrame, batch_id: int) -> None:
        nonlocal still
        if still >= idle:
            return
        done = embed(batch.filter("embedding IS NULL")).persist()
        pending, found = done.agg(F.count("*"), F.count("embedding")).first()
        if found:
            sink(done.filter("embedding IS NOT NULL"), batch_id)
        still = still + 1 if pending and not found else 0
        done.unpersist()

    return chunks.writeStream.foreachBatch(fill).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stage_durations(events: DataFrame, longest_ms: int | None = None) -> DataFrame:
    """Batch: each done event with the last start of its (stream_id, stage) before it; never negative.

    Starts more than ``longest_ms`` before are forgotten.
    """
    line = Window.partitionBy("stream_id", "stage").orderBy("ts", F.when(F.col("state") == "start", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    started = F.last(F.when(F.col("state") == "start", F.col("ts")), ignorenulls=True).over(line)
    ms = F.greatest(F.lit(0).cast("long"), F.unix_millis("ts") - F.unix_millis("started"))
    found = events.withColumn("started", started).filter("state = 'done' AND started IS NOT NULL").select("stream_id", "stage", F.col("ts").alias("done_at"), ms.alias("duration_ms"))
    return found if longest_ms is None else found.filter(F.col("duration_ms") <= longest_ms)


def answer_metrics(events: DataFrame) -> DataFrame:
    """Per stream: first-token latency, tokens, and tokens a second where more than one token took time."""
    token = F.col("kind") == "token"
    stats = events.groupBy("stream_id").agg(
        F.min("ts").alias("asked"), F.min(F.when(token, F.col("ts"))).alias("first"), F.max(F.when(token, F.col("ts"))).alias("last"), F.sum(F.when(token, F.coalesce("count", F.lit(1)))).alias("tokens")
    )
    ms = lambda a, b: F.unix_millis(a) - F.unix_millis(b)
    took = ms("last", "first")
    return stats.select("stream_id", ms("first", "asked").alias("ttft_ms"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.when((F.col("tokens") > 1) & (took > 0), 1000.0 * F.col("tokens") / took).alias("tokens_per_s"))


def conversation_activity(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.max("created_at").alias("last_activity"), F.count("*").alias("message_count"))


def counter_stream(deltas: DataFrame) -> DataFrame:
    """Counters from signed changes (doc_id, chunks, tokens)."""
    zero = F.lit(0).cast("long")
    return deltas.groupBy("doc_id").agg(F.greatest(F.sum("chunks"), zero).alias("chunk_count"), F.greatest(F.sum("tokens"), zero).alias("token_sum"))


def detect_loops(df: DataFrame, id: str = "message_id", text: str = "content") -> DataFrame:
    """Native twin of loops() for tables of whole texts."""
    end = F.when(F.length(text) >= LOOP_TAIL, F.substring(F.col(text), -LOOP_TAIL, LOOP_TAIL))
    last = F.when(F.length(text) > LOOP_WINDOW, F.substring(F.col(text), -LOOP_WINDOW, LOOP_WINDOW)).otherwise(F.col(text))
    n = F.when(end.isNull(), 0).otherwise((F.length(last) - F.length(F.replace(last, end, F.lit("")))) / LOOP_TAIL)
    return df.select(id, F.coalesce((n >= LOOP_TIMES) & end.rlike(r"[\p{L}\p{N}]"), F.lit(False)).alias("looping"))


__all__ = [
    "answer_metrics", "conversation_activity", "counter_stream", "debounce_changes", "detect_loops", "detect_loops_stream", "filter_think_stream", "loops",
    "stage_durations", "stream_backfill", "stream_file_ingest", "stream_reconcile", "stream_stage_durations", "think_step",
]
