"""Junk segments, filler lines and loops of recognised speech."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.text import normalise_line
from .hot import run_islands, scanned

#: Lines that recognisers make of silence and music, openings of credits, interjections.
FILLER = (
    "thank you", "thank you very much", "thank you so much", "thanks", "thanks for watching", "thank you for watching",
    "thanks for watching and see you next time", "please subscribe", "please like and subscribe", "like and subscribe",
    "subscribe to the channel", "see you next time", "see you in the next video", "you", "bye", "bye bye", "amen", "music",
    "applause", "silence", "blank audio", "gracias", "muchas gracias", "gracias por ver", "gracias por ver el video",
    "suscríbete", "danke", "vielen dank", "danke fürs zuschauen", "bis zum nächsten mal", "merci", "merci beaucoup",
    "merci d avoir regardé", "obrigado", "grazie", "продолжение следует", "спасибо",
)
CREDITS = (
    "subtitles by", "subtitled by", "subtitling by", "captions by", "captioning by", "captioned by", "transcribed by",
    "transcription by", "translated by", "subtítulos por", "subtítulos realizados por", "subtitulado por", "untertitel",
    "untertitelung", "sous titres", "sous titrage", "sottotitoli", "legendas pela", "amara org", "www ", "http",
)
INTERJECTIONS = ("oh", "ah", "uh", "um", "umm", "hmm", "mm", "mhm", "huh", "ooh", "eh", "ha", "la", "na")

MAX_LOOP, RECENT_S, RECENT_WORDS = 8, 30.0, 64


def _listed(names) -> Column:
    return F.array(*[F.lit(n) for n in names])


def is_filler(words: Column, filler=FILLER, credits=CREDITS, interjections=INTERJECTIONS) -> Column:
    """F4, of an array of words: every sentence with a letter or number is a filler line, begins like credits, or is
    made of interjections; and there is one."""
    lines = F.transform(F.split(F.concat_ws(" ", words), r"(?<=[.!?。！？])(?: |$)"), normalise_line)
    said = F.filter(lines, lambda s: s != "")
    junk = lambda s: F.array_contains(_listed(filler), s) | F.exists(_listed(credits), lambda p: F.startswith(s, p)) | F.forall(F.split(s, " "), lambda w: F.array_contains(_listed(interjections), w))
    return (F.size(said) > 0) & F.forall(said, junk)


def reject_reason(words: Column, no_speech: Column, avg_logprob: Column, max_no_speech: float = 0.6, min_avg_logprob: float = -1.0) -> Column:
    """why a decoder segment is dropped; null if it stays."""
    return F.when(no_speech > max_no_speech, "no_speech").when(avg_logprob < min_avg_logprob, "low_confidence").when(is_filler(words), "filler")


def drop_annotations(words: Column) -> Column:
    """F5, of an array of words."""
    return F.filter(words, lambda w: (w != "") & ~w.rlike(r"^[\[(*♪]"))


def keep_mask(keys: list[str], before: int = 0) -> list[bool]:
    """False for words that repeat the n words before them in a loop: a single word stands 4 times, longer runs 3
    times, in a row. The first copy stays. Runs of empty keys are no loops. ``before``: words at the front that are
    context only; loops may begin among them."""
    keep, i = [True] * len(keys), 0
    while i < len(keys):
        for n in range(1, MAX_LOOP + 1):
            run, copies = keys[i : i + n], 1
            if not any(run) or len(run) < n:
                continue
            while keys[i + copies * n : i + (copies + 1) * n] == run:
                copies += 1
            if copies >= (4 if n == 1 else 3):
                keep[i + n : i + copies * n] = [False] * ((copies - 1) * n)
                i += copies * n
                break
        else:
            i += 1
    return keep[before:]


def loop_mask(keys: Column) -> Column:
    """F6 over arrays of normalised words."""

    @F.pandas_udf("array<boolean>")
    def mask(s: pd.Series) -> pd.Series:
        return s.map(lambda k: keep_mask(list(k)) if k is not None else None)

    return mask(keys)


def collapse_loops(df: DataFrame, words: str) -> DataFrame:
    """the array column ``words`` without looped words, and ``n_looped``."""
    out = df.withColumn("__keep", loop_mask(F.transform(words, normalise_line)))
    kept = F.transform(F.filter(F.arrays_zip(F.col(words).alias("w"), F.col("__keep").alias("k")), lambda x: x["k"]), lambda x: x["w"])
    return out.withColumns({words: kept, "n_looped": (F.size(words) - F.size(kept)).cast("long")}).drop("__keep")


def admit(recent: list[tuple[str, float]], batch: list[tuple[str, float, float]]) -> tuple[list[bool], list[tuple[str, float]]]:
    """Which of the batch's (key, start, end) words stay, given the (key, end) admitted lately, and the new memory:
    what ended up to ``RECENT_S`` seconds before the batch's first word starts."""
    if not batch:
        return [], recent
    recent = [(k, t) for k, t in recent if t >= batch[0][1] - RECENT_S][-RECENT_WORDS:]
    keep = keep_mask([k for k, _ in recent] + [k for k, _, _ in batch], len(recent))
    return keep, (recent + [(k, z) for (k, _, z), ok in zip(batch, keep) if ok])[-RECENT_WORDS:]


def guard_report(segments: DataFrame, by: list[str], **limits) -> DataFrame:
    """What the guard removes from decoder segments (``words, no_speech, avg_logprob``), per key: segments, those dropped
    by reason, and the looped words of those that stay."""
    rows = segments.withColumn("__why", reject_reason(F.col("words"), F.col("no_speech"), F.col("avg_logprob"), **limits))
    rows = collapse_loops(rows.withColumn("words", F.when(F.col("__why").isNull(), F.col("words")).otherwise(F.array().cast("array<string>"))), "words")
    return rows.groupBy(*by).agg(F.count("*").alias("segments"), *[F.count_if(F.col("__why") == r).alias(r) for r in ("no_speech", "low_confidence", "filler")], F.sum("n_looped").cast("long").alias("loop_words"))


def first_repeat(keys: list[str]) -> int:
    """The place where the first run of repeats that could be a loop is complete; the number of keys if there is none."""
    codes, first = pd.factorize(np.array(keys, dtype=object), use_na_sentinel=False)[0], len(keys)
    for n in range(1, MAX_LOOP + 1):
        least = 3 if n == 1 else 2 * n  # keys in a row that equal the n-th before them
        so_far = np.concatenate([[0], (codes[n:] == codes[:-n]).cumsum()])
        ends = np.flatnonzero(so_far[least:] - so_far[:-least] == least)
        if len(ends):
            first = min(first, int(ends[0]) + least - 1 + n)
    return first


class LoopPruner:
    """S5 over rows in order; a batch of arrival may go on in the next part, so the pieces of the last one wait.

    Where nothing repeats nothing is dropped: batches up to the first run of repeats stay as they are, and only those from there
    on are admitted one by one. That needs starts and ends that never fall, so that the memory is the end of what was admitted."""

    def __init__(self):
        self.recent, self.waiting = [], []

    def take(self, pdf: pd.DataFrame) -> pd.DataFrame | None:
        arrival = pdf["arrival_ms"].to_numpy()
        new = np.flatnonzero(arrival[1:] != arrival[:-1]) + 1
        over = bool(self.waiting) and self.waiting[-1]["arrival_ms"].iloc[-1] != arrival[0]
        last = int(new[-1]) if len(new) else 0
        if not last and not over:
            self.waiting.append(pdf)
            return None
        done = [*self.waiting, pdf.iloc[:last]] if last else self.waiting
        self.waiting = [pdf.iloc[last:]]
        return self._admitted(pd.concat(done) if len(done) > 1 else done[0])

    def end(self) -> pd.DataFrame | None:
        done, self.waiting = self.waiting, []
        return self._admitted(pd.concat(done)) if done else None

    def _admitted(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Whole batches."""
        arrival, keys, starts, ends = rows["arrival_ms"].to_numpy(), rows["key"].tolist(), rows["start_ms"].to_numpy() / 1000, rows["end_ms"].to_numpy() / 1000
        cuts = [0, *(np.flatnonzero(arrival[1:] != arrival[:-1]) + 1).tolist(), len(rows)]
        rising = bool((np.diff(starts) >= 0).all() and (np.diff([t for _, t in self.recent] + ends.tolist()) >= 0).all())
        keep, at, ahead = np.ones(len(rows), dtype=bool), 0, 1 << 14
        while at < len(cuts) - 1:
            a, z = cuts[at], cuts[at + 1]
            if rising:
                near = cuts[at:][: ahead + 1]
                before = a + first_repeat([k for k, _ in self.recent] + keys[a : near[-1]]) - len(self.recent)
                quiet = int(np.searchsorted(near, before, side="right")) - 1
                if quiet > 0:
                    self.recent = (self.recent + list(zip(keys[a : near[quiet]], ends[a : near[quiet]].tolist())))[-RECENT_WORDS:]
                    at, ahead = at + quiet, min(2 * ahead, 1 << 14)
                    continue
                ahead = max(ahead // 2, 64)
            keep[a:z], self.recent = admit(self.recent, list(zip(keys[a:z], starts[a:z].tolist(), ends[a:z].tolist())))
            at += 1
        return rows[keep]


def prune_loops(words: DataFrame) -> DataFrame:
    """S5 over ``words(stream_id, seq, text, start_ms, end_ms, arrival_ms)``: the words that stay, batch by batch of
    arrival. A batch that starts more than ``RECENT_S`` after all before it has ended remembers nothing: there a stream is cut."""
    keyed = words.withColumn("key", normalise_line(F.col("text")))
    rows = scanned(keyed, ["stream_id"], ["seq"], {"__ended": ("max", F.col("end_ms")), "__came": ("last", F.col("arrival_ms"))})
    cut = (F.col("arrival_ms") != F.col("__came")) & (F.col("start_ms") - F.col("__ended") > int(RECENT_S * 1000))
    kept = run_islands(rows, ["stream_id"], ["seq"], cut, LoopPruner, StructType([*rows.schema.fields, StructField("__island", LongType())]))
    return kept.select(*words.columns)
