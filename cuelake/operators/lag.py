"""Caption lag against references."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_words, let, norm_word, word_eq
from ..sources.staging import staged
from .joins import asof_join, range_join
from .ranks import nearest, with_ranks
from .stats import rank_percentiles


def words_in_segment(segments: DataFrame, words: DataFrame, value: str = "end", tasks: int | None = None) -> DataFrame:
    """Segments (which don't overlap) with ``ref_end``: the largest ``value`` of the words that start in them, else
    their end. A word belongs to the latest segment that starts at or before it: an as-of join."""
    segs = segments.select("stream_id", F.col("start").alias("seg_start"), F.col("end").alias("seg_end"))
    own = asof_join(words.select("stream_id", "start", F.col(value).alias("v")), segs, ["stream_id"], "start", "seg_start", ["seg_start", "seg_end"], tasks=tasks)
    most = own.filter("start < seg_end").groupBy("stream_id", F.col("seg_start").alias("start")).agg(F.max("v").alias("__v"))
    return segments.join(most, ["stream_id", "start"], "left").withColumn("ref_end", F.coalesce("__v", "end")).drop("__v")


def clip_lag(clips: DataFrame, words: DataFrame, after: float = 0.5) -> DataFrame:
    """Per clip the last emission of the words that end in it (or ``after`` seconds later) less its end."""
    spans = clips.withColumns({"__low": F.col("start"), "__high": F.col("end") + after})
    pairs = range_join(words.select("stream_id", F.col("end").alias("word_end"), "emit"), spans, ["stream_id"], "word_end", "__low", "__high", 10.0)
    last = pairs.groupBy("stream_id", "clip_id").agg(F.max("emit").alias("emit"))
    return clips.join(last, ["stream_id", "clip_id"], "left").withColumn("lag_s", F.col("emit") - F.col("end"))


def loop_occurrences(utts: DataFrame, span: DataFrame, period: float) -> DataFrame:
    """Each utterance for every loop k in which its time falls into the stream's span (``low``, ``high``)."""
    k = F.sequence(F.floor(F.col("low") / period).cast("long"), F.floor(F.col("high") / period).cast("long"))
    rows = utts.join(span, "stream_id").withColumn("loop", F.explode(k))
    rows = rows.withColumns({"start": F.col("start") + F.col("loop") * period, "end": F.col("end") + F.col("loop") * period})
    return rows.filter((F.col("end") >= F.col("low")) & (F.col("start") <= F.col("high")))


def in_span(utts: DataFrame, span: DataFrame, max_lag: float) -> DataFrame:
    """utterances inside the captioned span with room for the largest lag."""
    return utts.join(span, "stream_id").filter((F.col("start") >= F.col("low")) & (F.col("end") + max_lag <= F.col("high"))).drop("low", "high")


def borrow_words(utts: DataFrame, least: int = 3) -> DataFrame:
    """``target``: an utterance's content words; one with fewer than ``least`` takes the last of up to three before
    it, around the loop's end."""
    rows = utts.withColumn("__own", content_words(F.col("text")))
    tail = Window.partitionBy("stream_id").orderBy(F.desc("utt"))
    front = rows.withColumn("__k", F.row_number().over(tail)).filter("__k <= 3").withColumn("__o", -F.col("__k")).drop("__k")
    both = rows.withColumn("__o", F.col("utt")).unionByName(front)
    before = F.flatten(F.collect_list("__own").over(Window.partitionBy("stream_id").orderBy("__o").rowsBetween(-3, -1)))
    lack = F.greatest(F.lit(least) - F.size("__own"), F.lit(0))
    taken = F.when(lack > 0, F.slice(before, F.greatest(F.size(before) - lack + 1, F.lit(1)), lack)).otherwise(F.array().cast("array<string>"))
    return both.withColumn("target", F.concat(taken, "__own")).filter("__o >= 0").drop("__own", "__o")


def match_count(target: Column, shown: Column, need: Column | None = None) -> Column:
    """Words of ``target`` found in ``shown``, equal up to a few edits (T14). The last one must be there; the others
    count in order, from the last backwards, within the target's length + 1 words before it. The best place of the last
    word counts; 0 if it isn't there. A place where ``need`` words can't be reached any more is followed no further: it counts
    fewer than ``need``."""
    n = F.size(target)
    most = n - need if need is not None else n  # words that may be missing
    earlier = F.reverse(F.slice(target, 1, F.greatest(n - 1, F.lit(0))))

    def from_place(e: Column) -> Column:
        low = F.greatest(e - n - 1, F.lit(0))

        def step(a: Column, t: Column) -> Column:
            there = F.when(a["at"] > low, F.array_max(F.filter(F.sequence(low, a["at"] - 1), lambda p: word_eq(F.get(shown, p), t))))
            after = let(there, lambda p: F.struct(F.coalesce(p, a["at"]).alias("at"), (a["n"] + p.isNotNull().cast("int")).alias("n"), (a["lack"] + p.isNull().cast("int")).alias("lack")))
            return F.when(a["lack"] > most, a).otherwise(after)

        return F.aggregate(earlier, F.struct(e.alias("at"), F.lit(1).alias("n"), F.lit(0).alias("lack")), step, lambda a: a["n"])

    places = F.filter(F.sequence(F.lit(0), F.size(shown) - 1), lambda e: word_eq(F.get(shown, e), F.get(target, n - 1)))
    return F.when((n > 0) & (F.size(shown) > 0), F.coalesce(F.array_max(F.transform(places, from_place)), F.lit(0))).otherwise(0)


def utterance_appearance(utts: DataFrame, cues: DataFrame, pre: float = 1.0, max_lag: float = 15.0) -> DataFrame:
    """For each occurrence (stream_id, loop, utt, ref_end, target) the first cue that starts from ``pre`` before to
    ``max_lag`` after its end and shows its words, all of two or fewer and all but one of more: ``appear_s``, ``lag_s``,
    ``words_matched``; null if none does."""
    spans = utts.withColumns({"__low": F.col("ref_end") - pre, "__high": F.col("ref_end") + max_lag})
    shown = cues.select("stream_id", F.col("start").alias("cue_start"), content_words(F.col("text")).alias("__shown"))
    pairs = range_join(shown, spans, ["stream_id"], "cue_start", "__low", "__high", pre + max_lag)
    need = F.when(F.size("target") <= 2, F.size("target")).otherwise(F.size("target") - 1)
    pairs = pairs.withColumn("n", match_count(F.col("target"), F.col("__shown"), need)).filter((F.col("n") >= need) & (F.size("target") > 0))
    first = pairs.groupBy("stream_id", "loop", "utt").agg(F.min("cue_start").alias("appear_s"), F.min_by("n", "cue_start").alias("words_matched"))
    return utts.join(first, ["stream_id", "loop", "utt"], "left").withColumn("lag_s", F.col("appear_s") - F.col("ref_end"))


def lag_summary(lags: DataFrame) -> DataFrame:
    """Share of matched utterances, and a summary of the lags."""
    lags = staged(lags.select("stream_id", "lag_s"), "lags")  # read twice
    plain = {"utterances": F.count("*"), "percent": 100.0 * F.count("lag_s") / F.count("*"), "max": F.max("lag_s")}
    out = with_ranks(lags, "lag_s", ["stream_id"], {"p50": nearest(0.5), "p95": nearest(0.95)}, plain)
    return out.select("stream_id", "utterances", F.col("n").alias("matched"), "percent", "p50", "p95", "max")


def caption_lag_now(arrivals: DataFrame) -> DataFrame:
    """Audio position less the end of the latest word, at each arrival."""
    w = Window.partitionBy("stream_id").orderBy("arrival_ms", "seq")
    return arrivals.withColumn("lag_ms", F.col("arrival_ms") - F.max("end_ms").over(w))


def clause_translation_delta(emits: DataFrame) -> DataFrame:
    """Per lane the seconds from a clause's last source push (lane 0) to its push there, pushes missing, and the
    queue wait. Input: stream_id, lane, clause, wall_ns, wait_ms."""
    source = emits.filter("lane = 0").groupBy("stream_id", "clause").agg(F.max("wall_ns").alias("__src"))
    lanes = emits.filter("lane <> 0").select("lane").distinct()
    due = source.crossJoin(F.broadcast(lanes))  # a few lanes
    got = emits.filter("lane <> 0").groupBy("stream_id", "lane", "clause").agg(F.max("wall_ns").alias("__wall"), F.max("wait_ms").alias("wait_ms"))
    rows = due.join(got, ["stream_id", "lane", "clause"], "left").withColumn("delta_s", (F.col("__wall") - F.col("__src")) / 1e9)
    missing = rows.groupBy("lane").agg(F.count("*").alias("clauses"), F.count_if(F.col("__wall").isNull()).alias("missing"), F.avg("wait_ms").alias("mean_wait_ms"))
    return missing.join(rank_percentiles(rows, "delta_s", ["lane"], "linear", {"p50": 0.5, "p95": 0.95}).drop("n"), "lane", "left")


def nearest_word(words: DataFrame, reference: DataFrame, within: float = 3.0) -> DataFrame:
    """For each word the closest reference word of the same spelling within some seconds: ``diff_s``. Only the
    last one before and the first one after can be the closest: two as-of joins."""
    keyed = lambda df: df.withColumn("key", norm_word(F.col("text"))).filter("key <> ''")
    ref = keyed(reference).select("stream_id", "key", F.col("start").alias("ref_start"))
    left = keyed(words).select("stream_id", "key", "seq", "start")
    below = asof_join(left, ref, ["stream_id", "key"], "start", "ref_start", ["ref_start"]).withColumnRenamed("ref_start", "below")
    turned = ref.select("stream_id", "key", (-F.col("ref_start")).alias("ref_start"))
    both = asof_join(below.withColumn("back", -F.col("start")), turned, ["stream_id", "key"], "back", "ref_start", ["ref_start"]).withColumn("above", -F.col("ref_start"))
    a, b = F.col("start") - F.col("below"), F.col("start") - F.col("above")
    diff = F.when(a.isNull() | (F.abs(b) < F.abs(a)), b).otherwise(a)
    return both.withColumn("diff_s", diff).filter(F.abs("diff_s") <= within).select("stream_id", "seq", "start", "diff_s")


def word_timing_error(diffs: DataFrame) -> DataFrame:
    """A22."""
    return rank_percentiles(diffs, "diff_s", ["stream_id"], "floor_n1", {"p5": 0.05, "p50": 0.5, "p95": 0.95})


def similarity(a: Column, b: Column) -> Column:
    """Twice the characters in matching blocks, over both lengths: the ratio of the standard library's sequence matcher,
    which has no built-in form."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)], dtype="float64")

    return ratio(a, b)


def exact_or_closest(expected: DataFrame, shown: DataFrame, least: float = 0.3) -> DataFrame:
    """Each expected line of a file: ``exact``, else the shown line with the highest :func:`similarity` of ``least`` or
    more (of equal ones the last in code-point order), else null.

    Only lines that aren't shown exactly are compared, once for each different text, with the shown lines of their file
    whose length allows the similarity."""
    there = shown.select("file", F.col("text")).distinct().withColumn("exact", F.lit(True))
    rows = expected.join(there, ["file", "text"], "left").withColumn("exact", F.coalesce("exact", F.lit(False)))
    misses = rows.filter(~F.col("exact")).select("file", "text").distinct()
    a, b = F.length("text"), F.length("other")
    near = misses.join(there.select("file", F.col("text").alias("other")), "file").filter((a + b == 0) | (2 * F.least(a, b) >= least * (a + b)))
    scored = near.withColumn("similarity", similarity(F.col("other"), F.col("text"))).filter(F.col("similarity") >= least)
    best = scored.groupBy("file", "text").agg(F.max_by("other", F.struct("similarity", "other")).alias("closest"), F.max("similarity").alias("similarity"))
    return rows.join(best.withColumn("exact", F.lit(False)), ["file", "text", "exact"], "left").select(*expected.columns, "exact", "closest", "similarity")


def first_appearance(cues: DataFrame, lines: DataFrame) -> DataFrame:
    """The first cue in which each line stands whole, its lag against the line's time, null if none."""
    each = cues.select("stream_id", F.col("start").alias("cue_start"), F.explode(F.split("text", "\n")).alias("line"))
    first = each.groupBy("stream_id", "line").agg(F.min("cue_start").alias("appear_s"))
    return lines.join(first, ["stream_id", "line"], "left").withColumn("lag_s", F.col("appear_s") - F.col("at_s"))
