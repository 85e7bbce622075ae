"""From hypotheses and tokens to committed words."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..functions.text import norm_word
from .ordered import run_ordered

HISTORY, SLACK_S = 200, 0.05


@lru_cache(1 << 16)
def norm(word: str) -> str:
    """T5 in Python: letters, digits and ' in lower case."""
    return "".join(c for c in word if c.isalnum() or c == "'").lower()


def skip_prefix(done: list[str], heard: list[str]) -> int:
    """Length of the prefix of ``heard`` with the fewest word edits to all of ``done``; of equal ones the longest.

    What both begin with costs nothing, and no prefix that ends within it is better. For the rest the columns of the edit table
    are bits of whole numbers (Myers' and Hyyrö's bit vectors), of which the last row's step gives the distance of each prefix."""
    n = next((i for i, (a, b) in enumerate(zip(done, heard)) if a != b), min(len(done), len(heard)))
    done, heard = done[n:], heard[n:]
    if not done:
        return n
    places: dict[str, int] = {}
    for i, word in enumerate(done):
        places[word] = places.get(word, 0) | 1 << i
    full, last = (1 << len(done)) - 1, 1 << len(done) - 1
    up, down, distance, best = full, 0, len(done), (len(done), 0)
    for j, word in enumerate(heard, 1):
        same = places.get(word, 0)
        x = same | down
        d = (((x & up) + up) ^ up) | x
        more, less = down | full & ~(d | up), up & d
        distance += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | full & ~(d | more), more & d
        if distance <= best[0]:
            best = distance, j
    return n + best[1]


class Agreement:
    """S3: words are committed when the last ``passes`` hypotheses begin alike."""

    def __init__(self, passes: int = 2):
        self.passes, self.history, self.kept = passes, [], []

    def add(self, words: list[tuple[str, float, float]], buffer_start: float, final: bool) -> list[tuple[str, float, float]]:
        done = [norm(t) for t, _, end in self.history if end > buffer_start + SLACK_S]
        fresh = words[skip_prefix(done, [norm(w[0]) for w in words]) :]
        fresh = [w for w in fresh if norm(w[0])]
        if final:
            self.kept, out = [], fresh
        else:
            self.kept = [*self.kept, fresh][-self.passes :]
            out = []
            if len(self.kept) == self.passes:
                for column in zip(*self.kept):
                    if len({norm(w[0]) for w in column}) > 1:
                        break
                    out.append(column[-1])
                self.kept = [h[len(out) :] for h in self.kept]
        self.history = (self.history + out)[-HISTORY:]
        return out


class _Committed:
    """A stream's passes in order to numbered rows."""

    def __init__(self, state: Agreement):
        self.state, self.n = state, 0

    def take(self, pdf: pd.DataFrame) -> list[tuple]:
        out = []
        for stream, pass_no, start, final, text, t0, t1 in zip(*[pdf[c] for c in ("stream_id", "pass_no", "buf_t0", "final", "text", "t0", "t1")]):
            for w in self.state.add(list(zip(text.tolist(), t0.tolist(), t1.tolist())), start, bool(final)):
                out.append((stream, self.n, pass_no, *w))
                self.n += 1
        return out

    def end(self) -> None:
        return None


def commit_agreed(hypotheses: DataFrame, passes: int = 2) -> DataFrame:
    """S3: committed words ``stream_id, seq, pass_no, text, t0, t1`` of ``hypotheses(stream_id, pass_no, buf_t0, final,
    words array<struct<text, t0, t1>>)``."""
    schema = StructType([hypotheses.schema["stream_id"], StructField("seq", LongType()), StructField("pass_no", LongType()), StructField("text", StringType()), StructField("t0", DoubleType()), StructField("t1", DoubleType())])

    # an array for each field: structs would be a dict for each word of each pass
    rows = hypotheses.select("stream_id", "pass_no", "buf_t0", "final", *[F.col(f"words.{c}").alias(c) for c in ("text", "t0", "t1")])
    return run_ordered(rows, ["stream_id"], ["pass_no"], lambda: _Committed(Agreement(passes)), schema)


def group_tokens(tokens: DataFrame, last_s: float = 0.08) -> DataFrame:
    """Words ``stream_id, word, text, t0, t1`` of subword tokens ``stream_id, i, token, t``. A space or U+2581 starts a
    word, ``<...>`` ends one and is dropped; a word ends ``last_s`` after its last token."""
    w = Window.partitionBy("stream_id").orderBy("i")
    special = F.col("token").rlike("^<.*>$")
    starts = F.col("token").rlike("^[ ▁]") | special | F.coalesce(F.lag(special).over(w), F.lit(True))
    rows = tokens.withColumn("__w", F.sum(starts.cast("int")).over(w)).filter(~special)
    text = F.regexp_replace(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "token"))), lambda x: x["token"]), ""), "[ ▁]", "")
    words = rows.groupBy("stream_id", "__w").agg(text.alias("text"), F.min("t").alias("t0"), (F.max("t") + last_s).alias("t1")).filter("text <> ''")
    return words.select("stream_id", (F.row_number().over(Window.partitionBy("stream_id").orderBy("__w")) - 1).alias("word"), "text", "t0", "t1")


def late_suffix(versions: DataFrame) -> DataFrame:
    """What is emitted of successive versions (stream_id, word, version, text, t0, t1) of a word: the first whole, of
    one that only grew the new end, at the word's end; other changes nothing."""
    w = Window.partitionBy("stream_id", "word").orderBy("version")
    before = F.lag("text").over(w)
    grew = F.startswith("text", before) & (F.length("text") > F.length(before))
    rows = versions.withColumn("emit", F.when(before.isNull(), F.col("text")).when(grew, F.substr("text", F.length(before) + 1)))
    return rows.withColumn("emit_t0", F.when(before.isNull(), F.col("t0")).otherwise(F.col("t1"))).filter("emit is not null")


def revision_rate(hypotheses: DataFrame) -> DataFrame:
    """Per stream passes, words shown, and words that differ from the pass before at the same place."""
    keys = F.transform("words", lambda x: norm_word(x["text"]))
    before = F.lag("__k").over(Window.partitionBy("stream_id").orderBy("pass_no"))
    rows = hypotheses.withColumn("__k", keys).withColumn("__b", before)
    n = F.least(F.size("__k"), F.size("__b"))
    changed = F.size(F.filter(F.zip_with(F.slice("__k", 1, n), F.slice("__b", 1, n), lambda a, b: a != b), lambda x: x))
    rows = rows.withColumn("__c", F.when(F.col("__b").isNull(), 0).otherwise(changed))
    out = rows.groupBy("stream_id").agg(F.count("*").alias("passes"), F.sum(F.size("words")).alias("shown"), F.sum("__c").alias("revised"))
    return out.withColumn("rate", F.coalesce(F.col("revised") / F.col("shown"), F.lit(0.0)))

