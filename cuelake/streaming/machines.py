"""Streaming forms of the ordered operators (S1, S5, S13, S14), with the same state machines as the batch forms.

A machine's state is one JSON value of its stream; Spark keeps it in the state store and restores it after a failure.
Rows of a micro-batch are worked on in order. Input that comes later than rows of the same stream that have been
worked on must be held back before (a watermark, or a source that is in order for each stream).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..functions.text import clause_end, clean, is_punct, normalise_line, sentence_end
from ..operators.cues import CueTrack
from ..operators.guard import admit
from ..operators.lanes import Shedding
from ..operators.segment import MAX_WAIT_MS, Clauses


class Machine(StatefulProcessor):
    """``step(state, row)`` gives output rows and changes the state, a dict; ``idle(state)`` gives those of a stream
    from which nothing has come for ``idle_ms``."""

    order: tuple[str, ...] = ("seq",)
    idle_ms: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "json string")

    def _load(self) -> dict[str, Any]:
        return json.loads(self.state.get()[0]) if self.state.exists() else {}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, out = self._load(), []
        for row in pd.concat(list(rows)).sort_values(list(self.order)).to_dict("records"):
            out += self.step(key, state, row)
        self.state.update((json.dumps(state),))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self._load()
        out = self.idle(key, state)
        self.state.update((json.dumps(state),))
        if out:
            yield pd.DataFrame(out)

    def step(self, key, state: dict, row: dict) -> list[dict]:
        raise NotImplementedError

    def idle(self, key, state: dict) -> list[dict]:
        return []

    def close(self) -> None:
        pass


def glue(left: str, word: str) -> str:
    """T11 for one word."""
    from ..functions.text import OPENING

    cjk = lambda c: any(a <= c <= z for a, z in (("　", "ヿ"), ("㐀", "䶿"), ("一", "鿿"), ("豈", "﫿"), ("＀", "￯")))
    bare = not any(c.isalnum() for c in word) and not all(c in OPENING for c in word)
    tight = not left or bare or left[-1] in OPENING or (cjk(left[-1]) and cjk(word[0]))
    return left + ("" if tight else " ") + word


class ClauseMachine(Machine):
    """Marked words to clauses."""

    def __init__(self, max_wait_ms: int = MAX_WAIT_MS, idle_ms: int | None = None):
        self.max_wait_ms, self.idle_ms = max_wait_ms, idle_ms

    def step(self, key, state, row):
        machine = Clauses(self.max_wait_ms, state.get("open", []), state.get("last"))
        now, out = int(row["arrival_ms"]), []

        def closed(event, words):
            if event:
                out.extend(self._clause(key, state, words[: event[0]], event[1], event[2]))

        before = list(machine.open)
        if state.get("arrival") != now:
            closed(machine.idle(now), before)
        if row["text"]:
            end = state.get("end")
            word = {k: row[k] for k in ("text", "punct", "ends", "comma")} | {"start_ms": int(row["start_ms"]), "end_ms": int(row["end_ms"]), "gap_ms": max(0, int(row["start_ms"]) - end) if end is not None else 0}
            state["end"] = max(word["start_ms"], word["end_ms"])
            before = list(machine.open)
            closed(machine.before(word, now), before)
            before = [*machine.open, word]
            closed(machine.add(word, now), before)
        if machine.open:
            machine.last = now
        state.update(open=machine.open, last=machine.last, arrival=now)
        return out

    def idle(self, key, state):
        out = self._clause(key, state, state.get("open", []), "end", state.get("last") or 0) if state.get("open") else []
        state["open"] = []
        return out

    def _clause(self, key, state, words, reason, at):
        new_row, state["reason"] = state.get("reason") != "max_words", reason
        if all(w["punct"] for w in words):
            return []
        text = ""
        for w in words:
            text = glue(text, w["text"])
        state["id"] = state.get("id", -1) + 1
        return [{"stream_id": key[0], "id": state["id"], "text": text, "start_ms": words[0]["start_ms"], "end_ms": words[-1]["end_ms"], "n_words": len(words), "new_row": new_row, "reason": reason, "closed_ms": at}]


class LoopMachine(Machine):
    """Words that don't go on a loop. Rows of one arrival are a batch, so a micro-batch has to hold it whole."""

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        state, keep = self._load(), []
        pdf = pd.concat(list(rows)).sort_values("seq")
        recent = [tuple(x) for x in state.get("recent", [])]
        for _, batch in pdf.groupby("arrival_ms", sort=False):
            ok, recent = admit(recent, list(zip(batch["key"], batch["start_ms"] / 1000, batch["end_ms"] / 1000)))
            keep += ok
        self.state.update((json.dumps({"recent": recent}),))
        if any(keep):
            yield pdf[keep]


class CueMachine(Machine):
    """Caption lines to cues."""

    def __init__(self, rows: int = 2, max_chars: int = 42, hold: int = 360_000, idle_ms: int | None = None):
        self.settings, self.idle_ms = (rows, max_chars, hold), idle_ms

    def _track(self, state):
        track = CueTrack(*self.settings)
        track.lines, track.start, track.until = state.get("lines", []), state.get("start"), state.get("until", 0)
        return track

    def _out(self, key, state, track, cue):
        state.update(lines=track.lines, start=track.start, until=track.until)
        return [{"stream_id": key[0], "lang": key[1], "start": cue[0], "end": cue[1], "text": cue[2]}] if cue else []

    def step(self, key, state, row):
        track = self._track(state)
        return self._out(key, state, track, track.line(row["text"] or "", bool(row["new_row"]), int(row["due"])))

    def idle(self, key, state):
        track = self._track(state)
        return self._out(key, state, track, track.close(track.until))


class SheddingMachine(Machine):
    """Lag snapshots (``lags``: a JSON object of lane and lag) to changes of state."""

    order = ("at_ms",)

    def __init__(self, order: list[str], source: str, limit_ms: int, source_only: bool = False):
        self.settings = (order, source, limit_ms, source_only)

    def step(self, key, state, row):
        machine = Shedding(*self.settings)
        machine.paused, machine.changed, machine.calm = state.get("paused", []), state.get("changed"), state.get("calm")
        out = machine.decide(int(row["at_ms"]), json.loads(row["lags"]))
        state.update(paused=machine.paused, changed=machine.changed, calm=machine.calm)
        return [{"stream_id": key[0], "changed_ms": int(row["at_ms"]), "lang": lang, "paused": pause} for lang, pause in out]


def _run(rows: DataFrame, keys: list[str], machine: Machine, schema: StructType) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    mode = "ProcessingTime" if machine.idle_ms is not None else "None"
    return rows.groupBy(*keys).transformWithStateInPandas(statefulProcessor=machine, outputStructType=schema, outputMode="Append", timeMode=mode)


def stream_clauses(words: DataFrame, max_wait_ms: int = MAX_WAIT_MS, idle_ms: int | None = 60_000) -> DataFrame:
    """S1 on a stream of ``words(stream_id, seq, text, start_ms, end_ms, arrival_ms)``. A stream from which nothing comes
    for ``idle_ms`` closes what is open; with None it waits."""
    text = clean(F.col("text"))
    rows = words.select("stream_id", "seq", text.alias("text"), "start_ms", "end_ms", "arrival_ms", is_punct(text).alias("punct"), sentence_end(text).alias("ends"), clause_end(text).alias("comma"))
    field = StructField
    schema = StructType([words.schema["stream_id"], field("id", LongType()), field("text", StringType()), field("start_ms", LongType()), field("end_ms", LongType()), field("n_words", LongType()), field("new_row", BooleanType()), field("reason", StringType()), field("closed_ms", LongType())])
    return _run(rows, ["stream_id"], ClauseMachine(max_wait_ms, idle_ms), schema)


def stream_prune_loops(words: DataFrame) -> DataFrame:
    """S5 on a stream."""
    rows = words.withColumn("key", normalise_line(F.col("text")))
    return _run(rows, ["stream_id"], LoopMachine(), rows.schema).drop("key")


def stream_cues(lines: DataFrame, rows: int = 2, max_chars: int = 42, hold: int = 360_000, idle_ms: int | None = 60_000) -> DataFrame:
    """S13 on a stream of ``lines(stream_id, lang, seq, text, new_row, due)``."""
    schema = StructType([lines.schema["stream_id"], StructField("lang", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("text", StringType())])
    return _run(lines, ["stream_id", "lang"], CueMachine(rows, max_chars, hold, idle_ms), schema)


def stream_shedding(snapshots: DataFrame, order: list[str], source: str, limit_ms: int, source_only: bool = False) -> DataFrame:
    """S14 on a stream of snapshots ``stream_id, at_ms, lags``."""
    schema = StructType([snapshots.schema["stream_id"], StructField("changed_ms", LongType()), StructField("lang", StringType()), StructField("paused", BooleanType())])
    return _run(snapshots, ["stream_id"], SheddingMachine(order, source, limit_ms, source_only), schema)


def stream_translations(clauses: DataFrame, translations: DataFrame, late: str = "10 seconds", window_s: int = 7) -> DataFrame:
    """J5 on streams: clauses (stream_id, id, closed_ts) with the translations (stream_id, clause_id, lang, text,
    arrival_ts) that come within ``window_s``; clauses without one come when the watermark has passed."""
    c = clauses.withWatermark("closed_ts", late).alias("c")
    t = translations.withWatermark("arrival_ts", late).alias("t")
    near = (F.col("t.arrival_ts") >= F.col("c.closed_ts")) & (F.col("t.arrival_ts") <= F.col("c.closed_ts") + F.expr(f"INTERVAL {window_s} SECONDS"))
    return c.join(t, (F.col("c.stream_id") == F.col("t.stream_id")) & (F.col("c.id") == F.col("t.clause_id")) & near, "left_outer").select("c.stream_id", "c.id", "c.closed_ts", "t.lang", "t.text", "t.arrival_ts")


def stream_counters(events: DataFrame, at: str, by: list[str], size: str = "1 minute", late: str = "10 seconds") -> DataFrame:
    """A11 on a stream: rows of each key in windows of time."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *by, "n")
