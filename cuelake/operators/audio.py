"""Audio rows: unpacking, framing, speech intervals, levels, silence, liveness."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..functions.times import dbfs
from .hot import run_islands, scanned

RATE, FRAME = 16_000, 1600


def decode_pcm(rows: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Binary little-endian 16-bit samples to ``samples array<smallint>``, and the rows whose body has an odd length."""
    good = rows.filter(F.octet_length(body) % 2 == 0)
    schema = StructType([*rows.drop(body).schema.fields])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            names = [n for n in b.schema.names if n != body]
            lists = pa.array([np.frombuffer(x.as_py(), "<i2") for x in b.column(b.schema.names.index(body))], pa.list_(pa.int16()))
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.names.index(n)) for n in names], lists], names=[*names, "samples"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return good.mapInArrow(run, f"{kinds}{', ' if kinds else ''}samples array<smallint>"), rows.filter(F.octet_length(body) % 2 == 1)


def to_mono(samples: Column, channels: int, pick: int | None = None) -> Column:
    """One channel of interleaved samples, 0 if it isn't there, or the mean of all, cut toward zero."""
    n = F.ceil(F.size(samples) / channels).cast("int")
    at = lambda i, c: F.coalesce(F.get(samples, (i * channels + c).cast("int")), F.lit(0)).cast("int")
    one = (lambda i: at(i, F.lit(pick)) if pick < channels else F.lit(0)) if pick is not None else (lambda i: (sum((at(i, F.lit(c)) for c in range(1, channels)), at(i, F.lit(0))) / channels).cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: one(i).cast("smallint"))).otherwise(F.array().cast("array<smallint>"))


def reframe_pcm(chunks: DataFrame, frame: int = FRAME, jump_ms: int = 20) -> DataFrame:
    """Chunks (stream_id, start_ms, samples) to frames of ``frame`` samples. A jump of more than ``jump_ms`` flushes
    a partial frame. Samples are placed by a running count, so frames are made by a plain grouping."""
    w = Window.partitionBy("stream_id").orderBy("start_ms")
    due = F.lag(F.col("start_ms") + F.size("samples") * 1000 / RATE).over(w)
    rows = chunks.withColumn("__jump", (due.isNull() | (F.abs(F.col("start_ms") - due) > jump_ms)).cast("int"))
    rows = rows.withColumn("run", F.sum("__jump").over(w))
    in_run = Window.partitionBy("stream_id", "run").orderBy("start_ms")
    rows = rows.withColumns({"__at": F.sum(F.size("samples")).over(in_run) - F.size("samples"), "__begin": F.min("start_ms").over(Window.partitionBy("stream_id", "run"))})
    first = F.floor(F.col("__at") / frame).cast("long")
    last = F.floor((F.col("__at") + F.size("samples") - 1) / frame).cast("long")
    parts = rows.filter(F.size("samples") > 0).withColumn("k", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("k") * frame - F.col("__at"), F.lit(0))
    high = F.least((F.col("k") + 1) * frame - F.col("__at"), F.size("samples"))
    piece = F.slice("samples", (low + 1).cast("int"), (high - low).cast("int"))
    parts = parts.select("stream_id", "run", "k", "__begin", F.struct(F.col("__at"), piece.alias("s")).alias("p"))
    out = parts.groupBy("stream_id", "run", "k").agg(F.first("__begin").alias("b"), F.sort_array(F.collect_list("p")).alias("ps"))
    return out.select("stream_id", (F.col("b") + F.col("k") * F.lit(frame * 1000 // RATE)).alias("start_ms"), F.flatten(F.transform("ps", lambda x: x["s"])).alias("samples"))


def level_windows(pcm: DataFrame) -> DataFrame:
    """``rms_dbfs`` and ``peak_dbfs`` of each row's samples; without samples -100."""
    total = F.aggregate("samples", F.lit(0.0), lambda a, s: a + s.cast("double") * s.cast("double"))
    peak = F.aggregate("samples", F.lit(0), lambda a, s: F.greatest(a, F.abs(s.cast("int"))))
    n = F.greatest(F.size("samples"), F.lit(1))
    return pcm.withColumns({"rms_dbfs": dbfs(F.sqrt(total / n) / 32768), "peak_dbfs": dbfs(peak / 32768.0)})


def silence_meter(levels: DataFrame, quiet_dbfs: float = -60.0, alert_s: float = 10.0) -> DataFrame:
    """Per window (stream_id, end_ms, rms_dbfs) the seconds of silence up to its end, and ``alert``."""
    w = Window.partitionBy("stream_id").orderBy("end_ms")
    loud = F.last(F.when(F.col("rms_dbfs") > quiet_dbfs, F.col("end_ms")), ignorenulls=True).over(w)
    since = F.coalesce(loud, F.first("end_ms").over(w) - 250)
    return levels.withColumn("silent_s", (F.col("end_ms") - since) / 1000).withColumn("alert", F.col("silent_s") >= alert_s)


class _Intervals:
    """One open interval of a stream; runs come in order, each with the end of the one before."""

    def __init__(self, pre_roll_ms: int, hangover_ms: int, young_ms: int):
        self.pre_roll_ms, self.hangover_ms, self.young_ms = pre_roll_ms, hangover_ms, young_ms
        self.open: tuple | None = None

    def row(self, stream, start: int, end: int, before: int) -> tuple | None:
        ended = self.open
        if ended and start - ended[2] < self.hangover_ms and start - ended[1] < self.young_ms:
            self.open = (*ended[:2], end)
            return None
        self.open = (stream, max(start - self.pre_roll_ms, before, 0), end)
        return ended

    def end(self) -> tuple | None:
        return self.open


def speech_intervals(blocks: DataFrame, pre_roll_ms: int = 600, hangover_ms: int = 1500, young_ms: int = 60_000) -> DataFrame:
    """Intervals of ``blocks(stream_id, start_ms, end_ms, speech)``, begun ``pre_roll_ms`` early (but not before the
    interval before). Intervals with a gap below ``hangover_ms`` are one while the interval is younger than
    ``young_ms``. A gap of ``hangover_ms`` always ends an interval: there a stream is cut."""
    given = scanned(blocks.filter("speech").select("stream_id", "start_ms", "end_ms"), ["stream_id"], ["start_ms"], {"before": ("last", F.col("end_ms"))})
    runs = scanned(given, ["stream_id"], ["start_ms"], {"run": ("sum", (F.coalesce("before", F.lit(-1)) != F.col("start_ms")).cast("long"))})
    runs = runs.groupBy("stream_id", "run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.coalesce(F.min_by("before", "start_ms"), F.lit(0)).alias("before"))
    schema = StructType([blocks.schema["stream_id"], StructField("start_ms", LongType()), StructField("end_ms", LongType())])
    cut = F.col("start_ms") - F.col("before") >= hangover_ms
    return run_islands(runs.drop("run"), ["stream_id"], ["start_ms", "end_ms"], cut, lambda: _Intervals(pre_roll_ms, hangover_ms, young_ms), schema, inputs=["stream_id", "start_ms", "end_ms", "before"])


def outages(data: DataFrame, after_ms: int) -> DataFrame:
    """``stream_id, start_ms, end_ms``: a gap of ``after_ms`` or more opens an outage that ends with the next key row
    (any row, if there is no ``is_key``); null: not yet."""
    w = Window.partitionBy("stream_id").orderBy("at_ms")
    key = F.col("is_key") if "is_key" in data.columns else F.lit(True)
    back = F.first(F.when(key, F.col("at_ms")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = data.withColumns({"__gap": F.lead("at_ms").over(w) - F.col("at_ms"), "end_ms": back})
    return rows.filter(F.col("__gap") >= after_ms).groupBy("stream_id", "end_ms").agg(F.min(F.col("at_ms") + after_ms).alias("start_ms")).select("stream_id", "start_ms", "end_ms")


def heartbeat_gaps(beats: DataFrame, hung_ms: int = 3000, healthy_ms: int = 60_000) -> DataFrame:
    """Spells of a worker between hangs: start, end, restarts in a row before it (none after a spell of
    ``healthy_ms``), and the wait before it, doubling from 0.5 s to 10 s."""
    w = Window.partitionBy("worker").orderBy("at_ms")
    rows = beats.withColumn("spell", F.sum((F.col("at_ms") - F.lag("at_ms").over(w) > hung_ms).cast("int")).over(w))
    spells = rows.groupBy("worker", F.coalesce("spell", F.lit(0)).alias("spell")).agg(F.min("at_ms").alias("start_ms"), F.max("at_ms").alias("end_ms"))
    s = Window.partitionBy("worker").orderBy("spell")
    long_before = F.coalesce((F.lag("end_ms").over(s) - F.lag("start_ms").over(s)) >= healthy_ms, F.lit(False))
    group = F.sum(long_before.cast("int")).over(s)
    spells = spells.withColumn("__g", group)
    k = F.row_number().over(Window.partitionBy("worker", "__g").orderBy("spell")) - 1
    return spells.withColumn("restarts", k).withColumn("wait_s", F.when(F.col("spell") == 0, 0.0).otherwise(F.least(0.5 * F.pow(F.lit(2.0), F.col("restarts")), F.lit(10.0)))).drop("__g")


def recovery_time(events: DataFrame) -> DataFrame:
    """Seconds from each loss of a worker (``kind`` lost) to its next ``ready``."""
    w = Window.partitionBy("worker").orderBy("at_ms").rowsBetween(1, Window.unboundedFollowing)
    ready = F.first(F.when(F.col("kind") == "ready", F.col("at_ms")), ignorenulls=True).over(w)
    return events.withColumn("__r", ready).filter("kind = 'lost'").select("worker", F.col("at_ms").alias("lost_ms"), ((F.col("__r") - F.col("at_ms")) / 1000).alias("recovery_s"))


def with_speech_flag(pcm: DataFrame, detect: Callable) -> DataFrame:
    """``speech`` by a user's function from a list of sample arrays to a list of booleans."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            flags = detect([x.values.to_numpy(zero_copy_only=False) for x in b.column(b.schema.names.index("samples"))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(flags), pa.bool_())], names=[*b.schema.names, "speech"])

    return pcm.mapInArrow(run, StructType([*pcm.schema.fields, StructField("speech", BooleanType())]))


def transcribe(pcm: DataFrame, recognise: Callable) -> DataFrame:
    """``words array<struct<text,t0,t1>>`` by a user's function from a list of sample arrays to lists of (text, t0, t1)."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pcm.schema)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("text", pa.string()), ("t0", pa.float64()), ("t1", pa.float64())]))
        for b in batches:
            found = recognise([x.values.to_numpy(zero_copy_only=False) for x in b.column(b.schema.names.index("samples"))])
            words = pa.array([[{"text": t, "t0": a, "t1": z} for t, a, z in w] for w in found], kind)
            yield pa.RecordBatch.from_arrays([*b.columns, words], names=[*b.schema.names, "words"])

    return pcm.mapInArrow(run, f"{kinds}, words array<struct<text:string,t0:double,t1:double>>")
