"""Languages as lanes: fan-out, routes, staleness, lag, load shedding."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..sources.staging import staged
from .joins import state_asof
from .ordered import run_ordered

STALE_MS, LAG_MS, PENDING_MS = 6000, 10_000, 7000


def fanout_targets(clauses: DataFrame, languages: DataFrame, paused: DataFrame | None = None) -> DataFrame:
    """A row for each clause and target language; the source and paused lanes (``stream_id, lang``) are left out."""
    targets = languages.filter("not source").select(F.col("code").alias("lang"))
    out = clauses.crossJoin(F.broadcast(targets))  # a few languages
    return out if paused is None else out.join(paused.select("stream_id", "lang"), ["stream_id", "lang"], "left_anti")


def translation_join(clauses: DataFrame, translations: DataFrame, langs: DataFrame | None = None) -> DataFrame:
    """Translations with their clause's closing time and ``age_ms`` (null: unknown clause). With ``langs`` every
    clause and language, and ``pending`` where nothing came."""
    closed = clauses.select("stream_id", F.col("id").alias("clause_id"), "closed_ms")
    if langs is None:
        out = translations.join(closed, ["stream_id", "clause_id"], "left")
    else:
        out = closed.crossJoin(F.broadcast(langs)).join(translations, ["stream_id", "clause_id", "lang"], "left")
        out = out.withColumn("pending", F.col("arrival_ms").isNull())
    return out.withColumn("age_ms", F.greatest(F.col("arrival_ms") - F.col("closed_ms"), F.lit(0)))


def drop_stale(translations: DataFrame, clauses: DataFrame, changes: DataFrame | None = None, most_ms: int = STALE_MS) -> DataFrame:
    """translations with ``drop``: stale (too old, or of an unknown clause), paused (by the lane's state log), or
    null for what stays."""
    rows = translation_join(clauses, translations)
    stale = F.col("closed_ms").isNull() | (F.col("age_ms") > most_ms)
    if changes is None:
        return rows.withColumn("drop", F.when(stale, "stale"))
    rows = state_asof(rows, changes, ["stream_id", "lang"], "arrival_ms", "changed_ms", "paused")
    return rows.withColumn("drop", F.when(stale, "stale").when(F.col("paused"), "paused")).drop("paused")


def cap_backlog(queued: DataFrame, chars_per_s: float = 40.0, most_s: float = 6.0) -> DataFrame:
    """F8: queued texts (snapshot, stream_id, lang, seq, text, age_s, lead_s) that a lane keeps: none older than
    ``most_s``, and of the newest as many as can be shown in that time."""
    young = queued.filter(F.col("age_s") <= most_s)
    after = Window.partitionBy("snapshot", "stream_id", "lang").orderBy("seq").rowsBetween(0, Window.unboundedFollowing)
    return young.withColumn("__chars", F.sum(F.length("text")).over(after)).filter(F.col("__chars") / chars_per_s + F.col("lead_s") <= most_s).drop("__chars")


def lane_lag(queued: DataFrame, translations: DataFrame, pending: DataFrame) -> DataFrame:
    """A10: per snapshot and lane the largest of the oldest queued age, the last translation's latency if it is at most
    10 s old, and the oldest pending age if at most 7 s. Inputs have stream_id, at_ms, lang, and age_ms or (ago_ms,
    latency_ms)."""
    by = ["stream_id", "at_ms", "lang"]
    q = queued.groupBy(*by).agg(F.max("age_ms").alias("q"))
    t = translations.filter(F.col("ago_ms") <= LAG_MS).groupBy(*by).agg(F.min_by("latency_ms", "ago_ms").alias("t"))
    p = pending.filter(F.col("age_ms") <= PENDING_MS).groupBy(*by).agg(F.max("age_ms").alias("p"))
    out = q.join(t, by, "full").join(p, by, "full")
    return out.select(*by, F.greatest(*[F.coalesce(c, F.lit(0)) for c in "qtp"]).alias("lag_ms"))


class Shedding:
    """Which lanes are paused, one lag snapshot after another. ``order``: lanes in the order they are paused."""

    def __init__(self, order: list[str], source: str, limit_ms: int, source_only: bool = False, hold_ms: int = 3000, calm_ms: int = 10_000):
        self.order, self.source, self.limit_ms, self.source_only, self.hold_ms, self.calm_ms = order, source, limit_ms, source_only, hold_ms, calm_ms
        self.paused: list[str] = []
        self.changed: int | None = None
        self.calm: int | None = None

    def decide(self, now: int, lags: dict[str, int]) -> list[tuple[str, bool]]:
        worst = max((v for k, v in lags.items() if k not in self.paused), default=0)
        since = float("inf") if self.changed is None else now - self.changed
        out = []
        if worst > self.limit_ms:
            self.calm = None
            active = [x for x in self.order if x not in self.paused]
            if active and since >= self.hold_ms:
                out = [(x, True) for x in (active if self.source_only else active[:1])]
        elif 2 * worst < self.limit_ms:
            self.calm = now if self.calm is None else self.calm
            if self.paused and now - self.calm >= self.calm_ms and since >= self.calm_ms:
                out = [(x, False) for x in (reversed(self.paused) if self.source_only else self.paused[-1:])]
        else:
            self.calm = None
        for lang, pause in out:
            (self.paused.append if pause else self.paused.remove)(lang)
        self.changed = now if out else self.changed
        return out


class _Snapshots:
    """Rows of a stream in order to whole snapshots for ``Shedding``."""

    def __init__(self, names: list[str], state: Shedding):
        self.names, self.state = names, state
        self.stream, self.now, self.lags = None, None, {}

    def _decide(self) -> list[tuple]:
        return [] if self.now is None else [(self.stream, self.now, lang, str(pause).lower()) for lang, pause in self.state.decide(self.now, self.lags)]

    def take(self, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for self.stream, now, lang, lag in zip(pdf["stream_id"], pdf["at_ms"], pdf["lang"], pdf["lag_ms"]):
            if now != self.now:
                out += self._decide()
                self.now, self.lags = int(now), {}
            self.lags[lang] = lag
        return pd.DataFrame(out, columns=self.names)

    def end(self) -> pd.DataFrame:
        return pd.DataFrame(self._decide(), columns=self.names)


def degrade_policy(lags: DataFrame, languages: DataFrame, limit_ms: int, source_only: bool = False) -> DataFrame:
    """State changes ``stream_id, changed_ms, lang, paused`` from snapshots ``stream_id, at_ms, lang, lag_ms``.
    Of several rows of a lane in a snapshot the largest lag counts; rows without a time are left out."""
    rows = sorted(languages.collect(), key=lambda r: (-r["priority"], -r["position"]))  # a few languages
    order, source = [r["code"] for r in rows if not r["source"]], next((r["code"] for r in rows if r["source"]), "")
    kind = lags.schema["stream_id"].dataType
    schema = StructType([StructField("stream_id", kind), StructField("changed_ms", LongType()), StructField("lang", StringType()), StructField("paused", StringType())])

    make = lambda: _Snapshots(schema.names, Shedding(order, source, limit_ms, source_only))
    rows = lags.select("stream_id", "at_ms", "lang", "lag_ms").filter("at_ms is not null")
    return run_ordered(rows, ["stream_id"], ["at_ms", "lang", "lag_ms"], make, schema).withColumn("paused", F.col("paused") == "true")


def quality_counters(translations: DataFrame, changes: DataFrame) -> DataFrame:
    """Per stream and lane what was shown and dropped, and how often the lane was paused."""
    t = translations.groupBy("stream_id", "lang").agg(F.count_if(F.col("drop").isNull()).alias("shown"), F.count_if(F.col("drop") == "stale").alias("stale"), F.count_if(F.col("drop") == "paused").alias("paused_drops"))
    c = changes.groupBy("stream_id", "lang").agg(F.count_if("paused").alias("pauses"))
    return t.join(c, ["stream_id", "lang"], "full").fillna(0)


def route_models(models: DataFrame, pairs: DataFrame) -> DataFrame:
    """``source, target, hops, via``: the models that translate a pair. Installed direct, installed by English,
    catalogue direct, catalogue by English; of several, installed default, installed, default, first."""
    each = models.select("id", "source", F.explode("targets").alias("target"), "is_default", "installed", "position")
    rank = Window.partitionBy("source", "target").orderBy(F.desc(F.col("installed") & F.col("is_default")), F.desc("installed"), F.desc("is_default"), "position")
    best = each.withColumn("__k", F.row_number().over(rank)).filter("__k = 1").select("source", "target", "id", "installed")
    to_en = best.filter("target = 'en'").select("source", F.col("id").alias("a"), F.col("installed").alias("a_in"))
    from_en = best.filter("source = 'en'").select("target", F.col("id").alias("b"), F.col("installed").alias("b_in"))
    rows = pairs.filter("source <> target").join(best.withColumnRenamed("id", "d").withColumnRenamed("installed", "d_in"), ["source", "target"], "left").join(to_en, "source", "left").join(from_en, "target", "left")
    direct, pivot = F.array("d"), F.array("a", "b")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    hops = F.when(F.col("d_in"), direct).when(both & F.col("a_in") & F.col("b_in"), pivot).when(F.col("d").isNotNull(), direct).when(both, pivot)
    return rows.select("source", "target", hops.alias("hops"), F.when(F.size(hops) == 2, "en").alias("via"))


def pivot_plan(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """Per clause of ``requests(stream_id, clause_id, source, langs)`` the languages that are translated directly, and
    those by English; a wanted English text comes from the shared first hop if there is one."""
    each = requests.select("stream_id", "clause_id", "source", F.explode("langs").alias("target")).join(F.broadcast(routes), ["source", "target"], "left")
    lists = each.groupBy("stream_id", "clause_id").agg(F.sort_array(F.collect_list(F.when(F.size("hops") == 1, F.col("target")))).alias("direct"), F.sort_array(F.collect_list(F.when(F.size("hops") == 2, F.col("target")))).alias("pivot"))
    shared = (F.size("pivot") > 0) & F.array_contains("direct", "en")
    return lists.withColumns({"direct": F.when(shared, F.array_remove("direct", "en")).otherwise(F.col("direct")), "english_from_pivot": shared})


def merge_catalogue(builtin: DataFrame, user: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The catalogue with user rows (which replace by id or add), and the user rows that were skipped, with why.
    Rows have id, source, targets, variant_of, position. A user row whose variant isn't there goes, and so does
    one whose variant went, along chains of any length; rows that are each other's variants stay."""
    bad = user.withColumn("reason", F.when(F.col("id").isNull() | (F.trim("id") == ""), "no id").when(F.col("source").isNull(), "no source").when(F.size(F.coalesce("targets", F.array().cast("array<string>"))) == 0, "no targets"))
    first = Window.partitionBy("id").orderBy("position")
    ok = staged(bad.filter("reason is null").withColumn("__k", F.row_number().over(first)), "user-models")
    mine = ok.filter("__k = 1").drop("__k", "reason")
    kept = builtin.join(mine.select("id"), "id", "left_anti")
    gone = staged(without_variant(mine, kept), "lost-variants")
    reasons = [(bad.filter("reason is not null"), None), (ok.filter("__k > 1").drop("__k"), "duplicate id"), (mine.join(gone, "id", "left_semi").withColumn("reason", F.lit(None).cast("string")), "unknown variant")]
    skipped = reduce(lambda a, b: a.unionByName(b), [df if why is None else df.withColumn("reason", F.lit(why)) for df, why in reasons])
    return kept.unionByName(mine.join(gone, "id", "left_anti")), skipped


def without_variant(mine: DataFrame, others: DataFrame) -> DataFrame:
    """The ids of ``mine`` whose chain of variants leads to an id that is in neither table. Pointer jumping: each round a row
    takes what is known of the row that it points to, or points to where that one does, so a chain of n rows takes
    log2(n) rounds; each is written, and rows that point in a circle are left over when nothing new is known."""
    known = mine.select("id").withColumn("own", F.lit(True)).unionByName(others.select("id").withColumn("own", F.lit(False)))
    to = mine.select("id", F.col("variant_of").alias("to")).join(known.select(F.col("id").alias("to"), "own"), "to", "left")
    lost = F.when(F.col("to").isNull() | ~F.col("own"), False).when(F.col("own").isNull(), True)
    rows = staged(to.select("id", "to", lost.alias("lost")), "variants")
    left = None
    while (now := rows.filter("lost is null").count()) not in (0, left):
        left = now
        next_ = rows.select(F.col("id").alias("to"), F.col("to").alias("further"), F.col("lost").alias("known"))
        open_ = rows.filter("lost is null").drop("lost").join(next_, "to").select("id", F.coalesce("further", "to").alias("to"), F.col("known").alias("lost"))
        rows = staged(rows.filter("lost is not null").unionByName(open_), "variants")
    return rows.filter("lost").select("id")
