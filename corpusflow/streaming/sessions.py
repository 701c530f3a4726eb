"""Session memory over a message stream: the last messages of every conversation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusflow.functions.fixed_values import MAX_TURNS

MESSAGE = "turn bigint, role string, text string"
IDLE_MS = 24 * 3600 * 1000


class LastMessages(StatefulProcessor):
    """Keeps a conversation's newest messages; late ones take their place by turn number, repeats replace.

    A timer on event time ends a conversation that was idle: its state goes when the watermark passes its last
    message by ``idle_ms``. A message after that begins a new memory.
    """

    def __init__(self, most: int, idle_ms: int) -> None:
        self.most, self.idle_ms = most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("messages", MESSAGE)
        self.last = handle.getValueState("last", "ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        by_turn = {m[0]: m for m in self.held.get()}
        before = self.last.get()[0] if self.last.exists() else None
        last = before or 0
        for frame in rows:
            by_turn.update((int(m[0]), (int(m[0]), m[1], m[2])) for m in zip(frame["turn"], frame["role"], frame["text"]))
            last = max(last, int(frame["ts"].max().timestamp() * 1000))
        newest = [by_turn[t] for t in sorted(by_turn)[-self.most:]]
        self.held.put(newest)
        if last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.idle_ms)
            self.handle.registerTimer(last + self.idle_ms)
            self.last.update((last,))
        yield pd.DataFrame({
            "conv_id": [key[0]],
            "messages": [[dict(zip(("turn", "role", "text"), m)) for m in newest]],
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def newest_per_frame(most: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Each frame's newest messages per conversation; nothing is carried from one frame to the next."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.sort_values("turn").groupby("conv_id").tail(most)

    return cut


def stream_session(messages: DataFrame, max_turns: int = MAX_TURNS, delay: str = "1 hour", idle_ms: int = IDLE_MS) -> DataFrame:
    """Updates (conv_id, messages) from a stream of (conv_id, turn, role, text, ts).

    Messages may be late by `delay`. Each Arrow frame is first cut to what can survive - its own newest messages per
    conversation - so a task holds one frame, and a busy conversation sends a bounded number of rows a frame to
    the task that holds its state. Needs the RocksDB state store.
    """
    most = 2 * max_turns
    spoken = messages.where(F.col("role").isin("user", "assistant")).select("conv_id", "turn", "role", "text", "ts")

    return (
        spoken.mapInPandas(newest_per_frame(most), spoken.schema)
        .withWatermark("ts", delay)
        .groupBy("conv_id")
        .transformWithStateInPandas(
            LastMessages(most, idle_ms),
            outputStructType="conv_id bigint, messages array<struct<turn:bigint,role:string,text:string>>",
            outputMode="Update",
            timeMode="EventTime",
        )
    )
