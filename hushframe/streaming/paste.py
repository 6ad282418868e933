"""Pasted text as a stream: stateless detection and masking, and a cool-down for each host."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..functions import rules
from ..functions import text as T
from ..operators import detect, policy

EVENTS = "host string, ts timestamp, text string, mode string, decision string, trusted boolean, input_type string, enabled boolean"
DECISIONS = "host string, ts timestamp, silent boolean, prompt boolean, result string, late boolean"
_COLUMNS = ["host", "ts", "silent", "prompt", "result", "late"]


def paste_stream(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    """Events from a folder of Parquet files."""
    return spark.readStream.schema(schema).parquet(path)


def masked(events: DataFrame) -> DataFrame:
    """Accepted events with spans and masked text; works on a stream as on a table."""
    found = detect.detect(policy.accepted(events))
    return found.withColumn("masked", T.replace_spans(F.col("text"), detect.of_tier(F.col("spans"), "block"))).withColumn("has_block", F.size(detect.of_tier(F.col("spans"), "block")) > 0)


#: What cool-downs need of the session: the state store that keeps several variables for a key.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Cooldown(StatefulProcessor):
    """One host: pastes wait until the watermark is past them, so they are decided in order of time, however they came in.
    State is the time of the last prompt, which a timer clears when its window is over, and the pastes that wait."""

    def __init__(self, window_ms: int):
        self.window = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")
        self.waiting = handle.getListState("waiting", "us long, seq long, text string, mode string, decision string, masked string, has_block boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        seen = self.waiting.get() if self.waiting.exists() else ()
        n, mark, late = max((r[1] for r in seen), default=-1) + 1, timerValues.getCurrentWatermarkInMs(), []
        for frame in rows:
            for us, text, mode, decision, masked_text, block in zip(frame["ts"].astype("datetime64[us]").astype("int64").tolist(), *(frame[c].tolist() for c in ("text", "mode", "decision", "masked", "has_block"))):
                due = -(-us // 1000)
                if due <= mark:
                    late.append((key[0], pd.Timestamp(us, unit="us"), False, False, None, True))
                    continue
                self.waiting.appendValue((us, n, text, mode, decision, masked_text, bool(block)))
                self.handle.registerTimer(due)
                n += 1
        if late:
            yield pd.DataFrame(late, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs() * 1000
        waiting = sorted(self.waiting.get(), key=lambda r: (r[0], r[1])) if self.waiting.exists() else []
        due, rest = [r for r in waiting if r[0] <= upto], [r for r in waiting if r[0] > upto]
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for us, _, text, mode, decision, masked_text, block in due:
            quiet = last is not None and us - last < self.window * 1000
            silent = bool(block and (mode == rules.SILENT_MODE or (mode == rules.COOLDOWN_MODE and quiet)))
            prompt = bool(block and not silent)
            if prompt and mode == rules.COOLDOWN_MODE:
                last = us
            answer = {rules.ANSWERS["mask"]: masked_text, rules.ANSWERS["send"]: text}.get(decision)
            out.append((key[0], pd.Timestamp(us, unit="us"), silent, prompt, text if not block else masked_text if silent else answer, False))
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        over = None if last is None else (last + self.window * 1000) // 1000 + 1
        if last is not None and upto < last + self.window * 1000:
            self.last.update((last,))
            self.handle.registerTimer(over)
        elif self.last.exists():
            self.last.clear()
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def cooldown_decisions(events: DataFrame, minutes: int = 5, delay: str = "10 minutes") -> DataFrame:
    """Decisions for a stream of events: after a prompt, a host's pastes are masked without asking for a while. Events may
    come in any order within `delay`; a decision comes out when the watermark is past its event. Events that come later
    still come out at once, with `late` set, nothing to insert and no effect on others. The session needs the STATE_STORE setting."""
    found = masked(events.withWatermark("ts", delay)).select("host", "ts", "text", "mode", "decision", "masked", "has_block")
    window = max(1, min(120, minutes or 5)) * 60_000
    return found.groupBy("host").transformWithStateInPandas(Cooldown(window), DECISIONS, "append", "eventTime")


def late_counts(decisions: DataFrame) -> DataFrame:
    """(host, late, n): how many events of each host were decided, and how many came too late for it."""
    return decisions.groupBy("host", "late").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Pastes of a host without a pause of `gap`: their number, those with something to block, and when they were. Works on a
    stream as on a table; on a stream a session comes out when the watermark is past its end."""
    found = masked(events.withWatermark("ts", delay))
    by = found.groupBy("host", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("pastes"), F.count_if("has_block").alias("blocked"))
    return by.select("host", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "pastes", "blocked")


def windowed_counts(events: DataFrame, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Pastes and those with something to block, by host and time window."""
    found = masked(events.withWatermark("ts", delay))
    return found.groupBy(F.window("ts", window).alias("w"), "host").agg(F.count("*").alias("pastes"), F.count_if("has_block").alias("blocked")).select("host", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "pastes", "blocked")
