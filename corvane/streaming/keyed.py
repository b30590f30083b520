"""Jobs with state of their own for each stream: think filter, loop detector and stage clock.

All three keep a bounded state for a key and let it go: when the stream says it is over, or when a
timer finds it idle.  Timers follow event time where the rows have a ``ts`` (the watermark has to pass),
and the clock of the machine otherwise.  They need the RocksDB state store, which the functions select.

Rows of one key in one batch are taken in the order of ``seq``; across batches they count as they come.
The stage clock alone puts events in order of time, by holding them until the watermark has passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LOOP_TAIL, LOOP_WINDOW, LOOP_TIMES = 40, 1024, 3
OPEN, CLOSE = "<think>", "</think>"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def think_step(held: str, inside: bool, piece: str) -> tuple[str, str, bool]:
    """(text to pass on, text held back, inside a think block) after another piece."""
    text, out = held + piece, ""
    while True:
        tag = CLOSE if inside else OPEN
        at = text.find(tag)
        if at >= 0:
            out += "" if inside else text[:at]
            text, inside = text[at + len(tag) :], not inside
            continue
        tail = next((n for n in range(min(len(tag) - 1, len(text)), 0, -1) if tag.startswith(text[-n:])), 0)
        return out + ("" if inside else text[: len(text) - tail]), text[len(text) - tail :] if tail else "", inside


def loops(text: str, tail: int = LOOP_TAIL, window: int = LOOP_WINDOW, times: int = LOOP_TIMES) -> bool:
    """Do the last characters repeat without overlap in the last stretch; tails of symbols only don't count."""
    end = (text or "")[-tail:]
    return len(end) == tail and any(c.isalnum() for c in end) and text[-window:].count(end) >= times


class _Idle(StatefulProcessor):
    """A value for each key, and one timer that moves with the key's rows."""

    state_schema: str

    def __init__(self, idle_ms: int, event_time: bool):
        self.idle_ms, self.event_time = idle_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.state_schema)
        self.due = handle.getValueState("due", "ms long")

    def wait(self, latest_ms: int, timers) -> None:
        self.forget_timer()
        due = (max(latest_ms, timers.getCurrentWatermarkInMs()) if self.event_time else timers.getCurrentProcessingTimeInMs()) + self.idle_ms
        self.handle.registerTimer(due)
        self.due.update((due,))

    def forget_timer(self) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()

    def close(self) -> None:
        pass


class ThinkFilter(_Idle):
    """State: at most a tag's length of text, whether a block is open, the last number."""

    state_schema = "held string, inside boolean, seq long"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, inside, seq = self.value.get() if self.value.exists() else ("", False, -1)
        found = pd.concat(list(rows)).sort_values("seq")
        out, over = [], False
        for r in found.itertuples():
            text, held, inside = think_step(held, inside, r.piece or "")
            over = bool(r.last)
            if over:
                text, held, inside = text + ("" if inside else held), "", False
            seq = int(r.seq)
            out.append((key[0], seq, text))
        if over:
            self.forget_timer()
            self.value.clear()
        else:
            self.value.update((held, inside, seq))
            self.wait(int(found["at_ms"].max()), timerValues)
        yield pd.DataFrame(out, columns=["stream_id", "seq", "text"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """What an abandoned stream has held back is passed on; an open block is dropped."""
        held, inside, seq = self.value.get() if self.value.exists() else ("", True, -1)
        self.value.clear()
        self.due.clear()
        rows = [(key[0], seq, held)] if held and not inside else []
        yield pd.DataFrame(rows, columns=["stream_id", "seq", "text"]).astype({"stream_id": "int64", "seq": "int64", "text": "object"})


class LoopDetector(_Idle):
    """State: the last LOOP_WINDOW characters, and whether the stream has tripped."""

    state_schema = "ring string, tripped boolean"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ring, tripped = self.value.get() if self.value.exists() else ("", False)
        found = pd.concat(list(rows)).sort_values("seq")
        out, over = [], False
        for r in found.itertuples():
            over = bool(r.last)
            if not tripped:
                ring = (ring + (r.piece or ""))[-LOOP_WINDOW:]
                if loops(ring):
                    tripped, ring = True, ""
                    out.append((key[0], int(r.seq)))
        if over:
            self.forget_timer()
            self.value.clear()
        else:
            self.value.update((ring, tripped))
            self.wait(int(found["at_ms"].max()), timerValues)
        yield pd.DataFrame(out, columns=["stream_id", "seq"]).astype("int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.value.clear()
        self.due.clear()
        yield pd.DataFrame({"stream_id": [], "seq": []}).astype("int64")


class StageClock(StatefulProcessor):
    """State: events the watermark has not passed, and the last start for as long as a stage may take."""

    def __init__(self, longest_ms: int):
        self.longest_ms = longest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "us long, done boolean")
        self.start = handle.getValueState("start", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows))
        events = [(int(us), state == "done") for us, state in zip(found["at_us"], found["state"], strict=True) if state in ("start", "done")]
        if events:
            self.pending.appendList(events)
            # timers go off beyond their time: the watermark has passed all of that millisecond then
            for ms in {us // 1000 for us, _ in events}:
                self.handle.registerTimer(ms)
        yield _durations([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        events = sorted(self.pending.get())
        ripe = [e for e in events if e[0] // 1000 <= now]
        start = self.start.get()[0] if self.start.exists() else None
        out = []
        for us, done in ripe:
            if not done:
                start = us
            elif start is not None and us // 1000 - start // 1000 <= self.longest_ms:
                out.append((key[0], key[1], us, us // 1000 - start // 1000))
        if ripe:
            rest = events[len(ripe) :]
            self.pending.put(rest) if rest else self.pending.clear()
        if start is not None and start // 1000 + self.longest_ms <= now:
            self.start.clear()
        elif start is not None:
            self.start.update((start,))
            self.handle.registerTimer(start // 1000 + self.longest_ms)
        yield _durations(out)

    def close(self) -> None:
        pass


def _durations(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["stream_id", "stage", "done_us", "duration_ms"]).astype({"stream_id": "int64", "stage": "object", "done_us": "int64", "duration_ms": "int64"})


def _pieces(pieces: DataFrame, processor: type[_Idle], schema: str, idle_ms: int, late: str) -> DataFrame:
    pieces.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    timed = "ts" in pieces.columns
    if timed:
        rows = pieces.withWatermark("ts", late).withColumn("at_ms", F.unix_millis("ts"))
    else:
        rows = pieces.withColumn("at_ms", F.lit(0).cast("long"))
    return rows.groupBy("stream_id").transformWithStateInPandas(processor(idle_ms, timed), schema, "append", "EventTime" if timed else "ProcessingTime")


def filter_think_stream(pieces: DataFrame, idle_ms: int = 60_000, late: str = "10 seconds") -> DataFrame:
    """Removes think blocks from streams' token pieces, also where a tag is split over pieces.

    pieces: stream_id, seq, piece, last (true on a stream's final piece), and ts for event time.  A
    stream without a row for ``idle_ms`` is flushed: what may have been half a tag is passed on with the
    number of the last piece.
    """
    return _pieces(pieces, ThinkFilter, "stream_id long, seq long, text string", idle_ms, late)


def detect_loops_stream(pieces: DataFrame, idle_ms: int = 60_000, late: str = "10 seconds") -> DataFrame:
    """(stream_id, seq): the piece after which a stream first repeats itself, as loops() defines it, once a stream."""
    return _pieces(pieces, LoopDetector, "stream_id long, seq long", idle_ms, late)


def stream_stage_durations(events: DataFrame, longest_ms: int = 3_600_000, late: str = "10 minutes") -> DataFrame:
    """Stream twin of stage_durations() with the same ``longest_ms``, whatever order the events come in.

    Events later than ``late`` are dropped; a result appears when the watermark has passed its done event.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = events.withWatermark("ts", late).withColumn("at_us", F.unix_micros("ts"))
    out = rows.groupBy("stream_id", "stage").transformWithStateInPandas(StageClock(longest_ms), "stream_id long, stage string, done_us long, duration_ms long", "append", "EventTime")
    return out.select("stream_id", "stage", F.timestamp_micros("done_us").alias("done_at"), "duration_ms")
