"""Batch twins of the streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import jobs as N
from .views import chunks, messages, query, table


def _events(spark, d):
    e = table(spark, d, "events")
    return e.select((F.col("user_id") % 50).alias("stream_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


BURSTS = "WITH e AS (SELECT user_id % 50 AS workspace_id, epoch_us(ts::TIMESTAMP) // 1000 AS ms FROM events), g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY workspace_id ORDER BY ms) < 3600000 THEN 0 ELSE 1 END AS new FROM e), s AS (SELECT *, sum(new) OVER (PARTITION BY workspace_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS burst FROM g) SELECT workspace_id, min(ms)::BIGINT AS start_ms, (max(ms) + 3600000)::BIGINT AS end_ms, count(*) AS changes FROM s GROUP BY workspace_id, burst"


@query("debounce_changes", BURSTS)
def debounce_changes(spark, d):
    out = N.debounce_changes(_events(spark, d).withColumnRenamed("stream_id", "workspace_id"), "1 hour")
    return out.select("workspace_id", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "changes")


STAGES = "WITH e AS (SELECT user_id % 50 AS stream_id, CASE WHEN event_id % 2 = 0 THEN 'embed' ELSE 'rank' END AS stage, CASE WHEN event_type IN ('view', 'click') THEN 'start' ELSE 'done' END AS state, epoch_us(ts::TIMESTAMP) // 1000 AS ms, event_id FROM events), l AS (SELECT *, last_value(CASE WHEN state = 'start' THEN ms END IGNORE NULLS) OVER (PARTITION BY stream_id, stage ORDER BY ms, CASE WHEN state = 'start' THEN 0 ELSE 1 END ROWS UNBOUNDED PRECEDING) AS started FROM e) SELECT stream_id, stage, ms::BIGINT AS done_ms, greatest(0, ms - started)::BIGINT AS duration_ms FROM l WHERE state = 'done' AND started IS NOT NULL"


def stage_events(spark, d):
    stage = F.when(F.col("event_id") % 2 == 0, "embed").otherwise("rank")
    state = F.when(F.col("event_type").isin("view", "click"), "start").otherwise("done")
    return _events(spark, d).select("stream_id", stage.alias("stage"), state.alias("state"), "ts")


@query("stage_durations", STAGES)
def stage_durations(spark, d):
    out = N.stage_durations(stage_events(spark, d))
    return out.select("stream_id", "stage", F.unix_millis("done_at").alias("done_ms"), "duration_ms")


@query("answer_metrics", "WITH e AS (SELECT user_id % 50 AS stream_id, event_type IN ('view', 'click') AS token, epoch_us(ts::TIMESTAMP) // 1000 AS ms, CASE WHEN event_id % 3 = 0 THEN 2 END AS n FROM events), s AS (SELECT stream_id, min(ms) AS asked, min(ms) FILTER (token) AS first, max(ms) FILTER (token) AS last, sum(coalesce(n, 1)) FILTER (token) AS tokens FROM e GROUP BY 1) SELECT stream_id, (first - asked)::BIGINT AS ttft_ms, coalesce(tokens, 0)::BIGINT AS tokens, CASE WHEN tokens > 1 AND last > first THEN round(1000.0::DOUBLE * tokens / (last - first), 6) END AS tokens_per_s FROM s")
def answer_metrics(spark, d):
    e = _events(spark, d).withColumn("kind", F.when(F.col("event_type").isin("view", "click"), "token").otherwise("stage")).withColumn("count", F.when(F.col("event_id") % 3 == 0, 2))
    return N.answer_metrics(e).withColumn("tokens_per_s", F.round("tokens_per_s", 6))


@query("conversation_activity", "SELECT conv_id, max(created_at) AS last_activity, count(*) AS message_count FROM messages GROUP BY 1", "messages")
def conversation_activity(spark, d):
    return N.conversation_activity(messages(spark, d))


@query("counter_stream", "SELECT doc_id, greatest(sum(CASE WHEN ordinal % 4 = 3 THEN -1 ELSE 1 END), 0)::BIGINT AS chunk_count, greatest(sum(CASE WHEN ordinal % 4 = 3 THEN -token_count ELSE token_count END), 0)::BIGINT AS token_sum FROM chunks GROUP BY 1", "chunks")
def counter_stream(spark, d):
    sign = F.when(F.col("ordinal") % 4 == 3, -1).otherwise(1)
    return N.counter_stream(chunks(spark, d).select("doc_id", sign.cast("long").alias("chunks"), (sign * F.col("token_count")).alias("tokens")))


@query("detect_loops", "SELECT message_id, false AS looping FROM messages WHERE message_id % 2 = 1 UNION ALL SELECT message_id, length(content) >= 40 AS looping FROM messages WHERE message_id % 2 = 0", "messages")
def detect_loops(spark, d):
    m = messages(spark, d)
    tail = F.substring(F.regexp_replace("content", r"[^\p{L}\p{N}]+", "x"), 1, 40)
    whole = F.when((F.col("message_id") % 2 == 0) & (F.length("content") >= 40), F.concat("content", F.repeat(F.rpad(tail, 40, "x"), 3))).otherwise(F.col("content"))
    return N.detect_loops(m.select("message_id", whole.alias("content")))
