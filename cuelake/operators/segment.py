"""Words to clauses.

A pause of ``LONG_PAUSE_MS`` closes whatever is open, so a stream falls apart there into islands that don't depend on
each other, and a long stream is worked on by many tasks. What crosses an island (ids, rows, the last clause's timer)
is repaired afterwards by windows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clause_end, clean, is_punct, join_words, sentence_end

PAUSE_MS, LONG_PAUSE_MS, MIN_WORDS, MAX_WORDS = 350, 1000, 3, 24
MAX_WAIT_MS = 800


class Clauses:
    """The open clause of one stream. ``add`` takes marked words, ``idle`` the passing of time.

    Words are dicts with gap_ms, punct, ends (a sentence), comma. A close is (number of words, reason, ms)."""

    def __init__(self, max_wait_ms: int = MAX_WAIT_MS, open_=(), last: int | None = None):
        self.max_wait_ms, self.open, self.last = max_wait_ms, list(open_), last

    def spoken(self) -> int:
        return sum(not w["punct"] for w in self.open)

    def limit(self) -> int:
        return self.max_wait_ms if self.spoken() >= MIN_WORDS else max(self.max_wait_ms, LONG_PAUSE_MS)

    def _close(self, n: int, reason: str, at: int) -> tuple[int, str, int]:
        del self.open[:n]
        return n, reason, at

    def idle(self, now: int):
        """The timer's close before words that arrive at ``now``, if it fires."""
        if self.open and self.last is not None and now - self.last > self.limit():
            return self._close(len(self.open), "timer", self.last + self.limit())

    def before(self, word: dict, at: int):
        """The close by the pause before a word."""
        if self.open and word["gap_ms"] >= PAUSE_MS and (self.spoken() >= MIN_WORDS or word["gap_ms"] >= LONG_PAUSE_MS):
            return self._close(len(self.open), "pause", at)

    def add(self, word: dict, at: int):
        """The close that a word brings about."""
        self.open.append(word)
        spoken = self.spoken()
        if word["ends"] and spoken >= MIN_WORDS:
            return self._close(len(self.open), "punctuation", at)
        if spoken >= MAX_WORDS:
            cuts = [i + 1 for i, w in enumerate(self.open[:-1]) if i + 1 >= MIN_WORDS and w["comma"]]
            return self._close(cuts[-1] if cuts else len(self.open), "max_words", at)


def mark_words(words: DataFrame) -> DataFrame:
    """Cleaned words of ``words(stream_id, seq, text, start_ms, end_ms, arrival_ms)`` with the marks that clauses need."""
    order = Window.partitionBy("stream_id").orderBy("seq")
    rows = words.withColumn("text", clean(F.col("text"))).withColumn("blank", F.col("text") == "")
    end = F.when(~F.col("blank"), F.greatest("end_ms", "start_ms"))
    before = F.last(end, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.when(F.col("blank"), 0).otherwise(F.coalesce(F.greatest(F.col("start_ms") - before, F.lit(0)), F.lit(0)))
    rows = rows.withColumns({"gap_ms": gap.cast("long"), "punct": is_punct(F.col("text")), "ends": sentence_end(F.col("text")), "comma": clause_end(F.col("text"))})
    return rows.withColumn("island", F.sum((F.col("gap_ms") >= LONG_PAUSE_MS).cast("int")).over(order).cast("long"))


#: What the machine reads of a word, and what it gives for it.
_READ = ("arrival_ms", "gap_ms", "blank", "punct", "ends", "comma")
_MARKED = "part int, closed string, closed_ms long, flush boolean"


def _island(words: list[dict], max_wait_ms: int) -> list[dict]:
    """For each word of an island its clause (``part``). Rows of a clause's last word have how and when it closed;
    ``open`` is left for the repair. ``flush``: a source chunk ends after the word."""
    state, part, out, waiting, before = Clauses(max_wait_ms), 0, [], [], None

    def closed(event):
        nonlocal part, waiting
        if event:
            n, reason, at = event
            for r in waiting[:n]:
                r["part"] = part
            waiting[n - 1].update(closed=reason, closed_ms=at)
            waiting, part = waiting[n:], part + 1

    for w in words:
        now = w["arrival_ms"]
        row = {"part": -1, "closed": None, "closed_ms": None, "flush": False}
        if before is not None and now != before:
            closed(state.idle(now))
        if not w["blank"]:
            event = state.before(w, now)
            if event and out:
                out[-1]["flush"] = True
            closed(event)
            waiting.append(row)
            event = state.add(w, now)
            closed(event)
            row["flush"] = bool(event)
        if state.open:
            state.last = now
        out.append(row)
        before = now
    if waiting:
        for r in waiting:
            r["part"] = part
        waiting[-1].update(closed="open", closed_ms=state.last + state.limit())
    return out


def _islands(max_wait_ms: int):
    def run(batches: Iterator) -> Iterator:
        """Rows sorted by stream, island and seq, with what the machine gives for them; other columns pass as they are."""
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("part", pa.int32()), ("closed", pa.string()), ("closed_ms", pa.int64()), ("flush", pa.bool_())])
        waiting = []  # pieces of the last island, which may go on

        def marked(rows):
            words, out = rows.select(_READ).to_pylist(), []
            cuts = [0, *starts(rows).tolist(), rows.num_rows]
            for a, z in zip(cuts, cuts[1:]):
                out += _island(words[a:z], max_wait_ms)
            new = pa.RecordBatch.from_pylist(out, schema=schema)
            yield pa.RecordBatch.from_arrays([*rows.columns, *new.columns], names=[*rows.schema.names, *schema.names])

        def starts(rows):
            """Where islands begin, but for the first."""
            new = np.zeros(max(rows.num_rows - 1, 0), dtype=bool)
            for c in ("stream_id", "island"):
                codes = rows.column(c).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
                new |= codes[1:] != codes[:-1]
            return np.flatnonzero(new) + 1

        for batch in batches:
            if not batch.num_rows:
                continue
            if waiting and any(waiting[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in ("stream_id", "island")):
                yield from marked(pa.concat_batches(waiting))
                waiting = []
            cuts = starts(batch)
            last = int(cuts[-1]) if len(cuts) else 0
            if last:
                yield from marked(pa.concat_batches([*waiting, batch.slice(0, last)]))
                waiting = []
            waiting.append(batch.slice(last))
        if waiting:
            yield from marked(pa.concat_batches(waiting))

    return run


def mark_clauses(words: DataFrame, max_wait_ms: int = MAX_WAIT_MS) -> DataFrame:
    """Marked words with ``part``, ``closed``, ``closed_ms`` and ``flush`` (see :class:`Clauses`), repaired across
    islands: what is open at an island's end closes by the timer, by the pause, or at the end of the stream."""
    marked = mark_words(words)
    # sorted partitions instead of groups: islands are small, and a group costs some ms. All columns pass through: marking words
    # costs more than carrying them, and no join back marks them again
    ordered = marked.repartition("stream_id", "island").sortWithinPartitions("stream_id", "island", "seq")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema)
    rows = ordered.mapInArrow(_islands(max_wait_ms), f"{kinds}, {_MARKED}")
    order = Window.partitionBy("stream_id").orderBy("seq")
    first = F.lag("island").over(order)
    rows = rows.withColumn("island_start", (first != F.col("island")) | first.isNull())
    # blank words may stand between the last word of an island and the next one's first
    next_at = F.first(F.when(F.col("island_start"), F.col("arrival_ms")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    open_ = F.col("closed") == "open"
    reason = F.when(open_ & next_at.isNull(), "end").when(open_ & (next_at > F.col("closed_ms")), "timer").when(open_, "pause").otherwise(F.col("closed"))
    at = F.when(open_ & next_at.isNull(), F.col("arrival_ms")).when(open_ & (next_at <= F.col("closed_ms")), next_at).otherwise(F.col("closed_ms"))
    return rows.withColumns({"closed": reason, "closed_ms": at}).drop("island_start")


def segment_clauses(words: DataFrame, max_wait_ms: int = MAX_WAIT_MS) -> DataFrame:
    """``stream_id, id, text, start_ms, end_ms, n_words, new_row, reason, closed_ms, next_gap_ms``."""
    rows = mark_clauses(words, max_wait_ms).filter(~F.col("blank"))
    order = Window.partitionBy("stream_id").orderBy("seq")
    rows = rows.withColumn("next_gap_ms", F.lead("gap_ms").over(order))
    parts = rows.groupBy("stream_id", "island", "part").agg(
        F.min("seq").alias("first_seq"),
        F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("words"),
        F.min_by("start_ms", "seq").alias("start_ms"),
        F.max_by("end_ms", "seq").alias("end_ms"),
        F.count("*").alias("n_words"),
        F.bool_and("punct").alias("empty"),
        F.max_by("closed", "seq").alias("reason"),
        F.max_by("closed_ms", "seq").alias("closed_ms"),
        F.max_by("next_gap_ms", "seq").alias("next_gap_ms"),
    )
    clauses = Window.partitionBy("stream_id").orderBy("first_seq")
    parts = parts.withColumn("new_row", F.coalesce(F.lag("reason").over(clauses) != "max_words", F.lit(True)))
    said = parts.filter(~F.col("empty"))
    text = join_words(F.transform("words", lambda w: w["text"]))
    return said.select("stream_id", (F.row_number().over(clauses) - 1).cast("long").alias("id"), text.alias("text"), "start_ms", "end_ms", "n_words", "new_row", "reason", "closed_ms", "next_gap_ms")


def source_chunks(words: DataFrame, max_wait_ms: int = MAX_WAIT_MS) -> DataFrame:
    """The text of each arrival batch, broken where clauses close: ``stream_id, seq, text, new_row, at_ms``."""
    rows = mark_clauses(words, max_wait_ms).filter(~F.col("blank"))
    order = Window.partitionBy("stream_id").orderBy("seq")
    ends = F.col("flush") | (F.col("arrival_ms") != F.lead("arrival_ms").over(order)) | F.lead("arrival_ms").over(order).isNull()
    # a close that came with or after the chunk's last word, by any rule
    rows = rows.withColumns({"__ends": ends, "__chunk": F.coalesce(F.sum(ends.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")})
    cut = F.when(F.col("flush") & F.col("closed").isNull(), F.lit("max_words")).otherwise(F.col("closed"))
    chunks = rows.groupBy("stream_id", "__chunk").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("words"), F.max_by(cut, "seq").alias("closed"), F.max("arrival_ms").alias("at_ms"))
    before = F.lag("closed").over(Window.partitionBy("stream_id").orderBy("__chunk"))
    first = F.col("__chunk") == 0
    return chunks.select("stream_id", F.col("__chunk").alias("seq"), join_words(F.transform("words", lambda w: w["text"])).alias("text"), (first | F.coalesce(before != "max_words", F.lit(False))).alias("new_row"), "at_ms")


def clause_stats(clauses: DataFrame) -> DataFrame:
    """Clauses of each stream by reason, all of them, and timer closes before a pause."""
    by = ("punctuation", "pause", "timer", "max_words", "end")
    return clauses.groupBy("stream_id").agg(*[F.count_if(F.col("reason") == r).alias(r) for r in by], F.count("*").alias("total"), F.count_if((F.col("reason") == "timer") & (F.col("next_gap_ms") >= PAUSE_MS)).alias("timer_at_pause"))
