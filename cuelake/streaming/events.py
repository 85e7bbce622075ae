"""Streaming forms by event time (S10, S12, S15, S19): rows that come out of order wait in a bounded buffer.

Rows of a stream are kept in a map state under their time until the watermark has passed it, and then go through the machine
in order, so any order of arrival within the watermark's delay gives what the batch form gives. Machines name a deadline
in event time (an interval that ends if nothing comes, an outage that begins); a timer calls them when the watermark has
passed it, though no row came. Spark restores buffer, state and timers after a failure.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.times import WRAP


def _plain(value: Any) -> Any:
    return None if value is None or value != value else value.item() if hasattr(value, "item") else value


class EventMachine(StatefulProcessor):
    """``step(key, state, row)`` and, when ``state["deadline"]`` has passed, ``due(key, state)`` give output rows; rows have
    ``at``, their time in ms, and ``tie``, which orders rows of one time and tells them apart."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "json string")
        self.waiting = handle.getMapState("waiting", "at long, tie long", "json string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = set()
        for pdf in rows:
            for row in pdf.to_dict("records"):
                row = {k: _plain(v) for k, v in row.items() if k not in ("ts", "stream_id")}
                self.waiting.updateValue((row["at"], row["tie"]), (json.dumps(row),))
                times.add(row["at"])
        for at in times:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        state = json.loads(self.state.get()[0]) if self.state.exists() else {}
        before, out = state.get("deadline"), []
        for at, tie in sorted(k for k in self.waiting.keys() if k[0] <= now):
            row = json.loads(self.waiting.getValue((at, tie))[0])
            self.waiting.removeKey((at, tie))
            if (deadline := state.get("deadline")) is not None and deadline <= at:
                out += self._due(key, state)
            out += self.step(key, state, row)
        if (deadline := state.get("deadline")) is not None and deadline <= now:
            out += self._due(key, state)
        self.state.update((json.dumps(state),))
        if state.get("deadline") not in (None, before):
            self.handle.registerTimer(state["deadline"])
        if out:
            yield pd.DataFrame(out)

    def _due(self, key, state: dict) -> list[dict]:
        state["deadline"] = None
        return self.due(key, state)

    def step(self, key, state: dict, row: dict) -> list[dict]:
        raise NotImplementedError

    def due(self, key, state: dict) -> list[dict]:
        return []

    def close(self) -> None:
        pass


class Unwrapping(EventMachine):
    """S10. A late value from before a wrap is placed before it and leaves the count of wraps as it is."""

    def step(self, key, state, row):
        pts, last, turns = row["pts_90k"], state.get("last"), state.get("turns", 0)
        if last is not None and pts - last > WRAP // 2:
            return [{"stream_id": key[0], "seq": row["tie"], "pts_90k": pts, "pts_unwrapped": pts + (turns - 1) * WRAP}]
        if last is not None and pts - last < -(WRAP // 2):
            turns += 1
        state.update(last=pts, turns=turns)
        return [{"stream_id": key[0], "seq": row["tie"], "pts_90k": pts, "pts_unwrapped": pts + turns * WRAP}]


class Speech(EventMachine):
    """S12. An interval ends when a new one begins, or ``hangover_ms`` after its last block."""

    def __init__(self, pre_roll_ms: int, hangover_ms: int, young_ms: int):
        self.settings = pre_roll_ms, hangover_ms, young_ms

    def step(self, key, state, row):
        if not row["speech"]:
            return []
        pre_roll_ms, hangover_ms, young_ms = self.settings
        a, z, open_, out = row["at"], row["tie"], state.get("open"), []
        if open_ and (a == state["end"] or (a - state["end"] < hangover_ms and a - open_ < young_ms)):
            state["end"] = z
        else:
            out = self.due(key, state) if open_ is not None else []
            state.update(open=max(a - pre_roll_ms, state.get("end", 0), 0), end=z)
        state["deadline"] = z + hangover_ms
        return out

    def due(self, key, state):
        out = [{"stream_id": key[0], "start_ms": state["open"], "end_ms": state["end"]}]
        state["open"] = None
        return out


class Outages(EventMachine):
    """S15. A row when an outage begins (no end yet) and one when it ends."""

    def __init__(self, after_ms: int):
        self.after_ms = after_ms

    def step(self, key, state, row):
        out = []
        if state.get("since") is not None and row["is_key"]:
            out = [{"stream_id": key[0], "start_ms": state["since"], "end_ms": row["at"]}]
            state["since"] = None
        state.update(last=row["at"], deadline=row["at"] + self.after_ms)
        return out

    def due(self, key, state):
        if state.get("since") is not None:
            return []
        state["since"] = state["last"] + self.after_ms
        return [{"stream_id": key[0], "start_ms": state["since"], "end_ms": None}]


class Display(StatefulProcessor):
    """S19. A session's frames in order of PTS: the buffer holds ``depth`` frames, and gives its first when another comes."""

    def __init__(self, depth: int, idle_ms: int | None):
        self.depth, self.idle_ms = depth, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.given = handle.getValueState("given", "n long")
        self.waiting = handle.getMapState("waiting", "pts long, seq long", "held boolean")

    def _give(self, key, frames: list[tuple[int, int]]) -> Iterator[pd.DataFrame]:
        n = self.given.get()[0] if self.given.exists() else 0
        for k in frames:
            self.waiting.removeKey(k)
        self.given.update((n + len(frames),))
        if frames:
            yield pd.DataFrame([{"stream_id": key[0], "session": key[1], "seq": seq, "pts_90k": pts, "rank": n + i} for i, (pts, seq) in enumerate(frames)])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        import heapq

        came = pd.concat(list(rows)).sort_values("seq")
        held = [tuple(k) for k in self.waiting.keys()]
        heapq.heapify(held)
        frames = []
        for pts, seq in zip(came["pts_90k"].tolist(), came["seq"].tolist()):
            self.waiting.updateValue((pts, seq), (True,))
            heapq.heappush(held, (pts, seq))
            if len(held) > self.depth:
                frames.append(heapq.heappop(held))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield from self._give(key, frames)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._give(key, sorted(tuple(k) for k in self.waiting.keys()))

    def close(self) -> None:
        pass


def _by_event_time(rows: DataFrame, machine: EventMachine, schema: StructType, late: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = rows.filter("at is not null").withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", late)
    return timed.groupBy("stream_id").transformWithStateInPandas(statefulProcessor=machine, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def _schema(rows: DataFrame, *names: str) -> StructType:
    return StructType([rows.schema["stream_id"], *(StructField(n, LongType()) for n in names)])


def stream_unwrap_pts(rows: DataFrame, late: str = "10 seconds") -> DataFrame:
    """S10 on a stream of ``stream_id, seq, pts_90k, at_ms``."""
    given = rows.select("stream_id", F.col("at_ms").alias("at"), F.col("seq").alias("tie"), "pts_90k").filter("pts_90k is not null")
    return _by_event_time(given, Unwrapping(), _schema(rows, "seq", "pts_90k", "pts_unwrapped"), late)


def stream_speech_intervals(blocks: DataFrame, pre_roll_ms: int = 600, hangover_ms: int = 1500, young_ms: int = 60_000, late: str = "10 seconds") -> DataFrame:
    """S12 on a stream of ``blocks(stream_id, start_ms, end_ms, speech)``."""
    given = blocks.select("stream_id", F.col("start_ms").alias("at"), F.col("end_ms").alias("tie"), F.coalesce("speech", F.lit(False)).alias("speech"))
    return _by_event_time(given, Speech(pre_roll_ms, hangover_ms, young_ms), _schema(blocks, "start_ms", "end_ms"), late)


def stream_outages(data: DataFrame, after_ms: int, late: str = "10 seconds") -> DataFrame:
    """S15 on a stream of ``data(stream_id, at_ms[, is_key])``."""
    key = F.coalesce("is_key", F.lit(False)) if "is_key" in data.columns else F.lit(True)
    given = data.select("stream_id", F.col("at_ms").alias("at"), key.cast("long").alias("tie"), key.alias("is_key"))
    return _by_event_time(given, Outages(after_ms), _schema(data, "start_ms", "end_ms"), late)


def stream_display_order(frames: DataFrame, depth: int = 4, idle_ms: int | None = 60_000) -> DataFrame:
    """S19 on a stream of ``frames(stream_id, session, seq, pts_90k)`` in order of ``seq`` (as decoded): frames with their ``rank``
    in order of PTS, as long as none is shown more than ``depth`` frames after one that follows it. What is held
    comes when nothing has come for ``idle_ms``."""
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    given = frames.select("stream_id", "session", "seq", "pts_90k").filter("pts_90k is not null")
    return given.groupBy("stream_id", "session").transformWithStateInPandas(statefulProcessor=Display(depth, idle_ms), outputStructType=_schema(frames, "session", "seq", "pts_90k", "rank"), outputMode="Append", timeMode="None" if idle_ms is None else "ProcessingTime")
