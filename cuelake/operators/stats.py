"""Summaries, rank percentiles, trends, counters, top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from .ranks import nearest, with_ranks


def summary(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """A1: n, min, p50, p95, p99, max, mean, stddev per key; all 0 without rows. Percentiles are of rank
    ceil(p n)."""
    v = F.col(value).cast("double")
    plain = {"min": F.min(v), "max": F.max(v), "mean": F.avg(v), "stddev": F.stddev_pop(v)}
    out = with_ranks(df, value, list(by), {"p50": nearest(0.5), "p95": nearest(0.95), "p99": nearest(0.99)}, plain)
    return out.select(*by, "n", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("min", "p50", "p95", "p99", "max", "mean", "stddev")])


def rank_index(method: str, p: float, n: Column) -> Column:
    """A2: the place from 0, among n sorted values, that a rule for percentiles names; p from 0 to 1."""
    at = {
        "nearest": F.ceil(p * n) - 1,
        "linear": F.floor(p * (n - 1) + 0.5),
        "floor_n": F.floor(p * n),
        "floor_n1": F.floor(p * (n - 1)),
        "half_up": F.bround(p * n + 0.5) - 1,
    }[method]
    return F.greatest(F.lit(0), F.least(at.cast("long"), n - 1))


def rank_percentiles(df: DataFrame, value: str, by: list[str], method: str, ps: dict[str, float]) -> DataFrame:
    """A2: one column for each of ``ps`` (name: p), by one of five rules; null values don't count."""
    rows = df.filter(F.col(value).isNotNull())
    return with_ranks(rows, value, by, {k: (p, lambda n, p=p: rank_index(method, p, n)) for k, p in ps.items()})


def slope(y: Column, x: Column) -> Column:
    """A3: of the least-squares line, an aggregate; 0 without two different x."""
    return F.coalesce(F.regr_slope(y, x), F.lit(0.0))


def drift_ms_per_min(delay_ms: Column, at_s: Column) -> Column:
    return slope(delay_ms, at_s) * 60


def jitter(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """A4: population deviation, and mean absolute difference to the value before."""
    step = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(*order)))
    return df.select(*by, F.col(value).alias("__v"), step.alias("__d")).groupBy(*by).agg(F.coalesce(F.stddev_pop("__v"), F.lit(0.0)).alias("stddev"), F.coalesce(F.avg("__d"), F.lit(0.0)).alias("mean_step"))


def gap_to_previous(df: DataFrame, by: list[str], order: list[str], start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """``gap_ms`` between a word and the end of the one before, 0 at least."""
    before = F.lag(F.greatest(start, end)).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("gap_ms", F.coalesce(F.greatest(F.col(start) - before, F.lit(0)), F.lit(0)))


def next_start_as_end(df: DataFrame, by: list[str], order: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """W2."""
    return df.withColumn(end, F.coalesce(F.lead(start).over(Window.partitionBy(*by).orderBy(*order)), F.col(start)))


def previous_context(df: DataFrame, n: int, order: list[str], doc: str = "doc", text: str = "text", by: list[str] | None = None) -> DataFrame:
    """``context``, the texts of up to n rows before in the same stretch of rows of one document. ``by`` names the files
    whose rows stand in order; without it each document is a file."""
    w = Window.partitionBy(*(by or [doc])).orderBy(*order)
    near = F.collect_list(F.struct(F.col(doc).alias("doc"), F.col(text).alias("text"))).over(w.rowsBetween(-n, -1))
    # from the nearest row back: rows count until one is of another document
    step = lambda s, x: F.when(s["on"] & x["doc"].eqNullSafe(F.col(doc)), F.struct(F.lit(True).alias("on"), F.concat(F.array(x["text"]), s["texts"]).alias("texts"))).otherwise(F.struct(F.lit(False).alias("on"), s["texts"].alias("texts")))
    start = F.struct(F.lit(True).alias("on"), F.array().cast("array<string>").alias("texts"))
    return df.withColumn("context", F.aggregate(F.reverse(near), start, step, lambda s: s["texts"]))


def last_words(df: DataFrame, n: int, by: list[str], order: list[str], word: str = "text") -> DataFrame:
    """``tail``, the last n words up to and including the row's."""
    return df.withColumn("tail", F.collect_list(word).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - n, 0)))


def counter_delta(df: DataFrame, counters: list[str], by: list[str], order: list[str]) -> DataFrame:
    """Change of counters that only grow; after a restart, what they show. Null in the first row."""
    w = Window.partitionBy(*by).orderBy(*order)
    delta = lambda c: F.when(F.col(c) < F.lag(c).over(w), F.col(c)).otherwise(F.col(c) - F.lag(c).over(w))
    return df.withColumns({f"{c}_delta": delta(c) for c in counters})


def shed_order(languages: DataFrame, by: list[str] = ()) -> DataFrame:
    """O1: languages in the order in which they are paused: highest priority number first, later ones first."""
    return languages.filter("not source").withColumn("shed_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("priority"), F.desc("position"))))


def latest_n(df: DataFrame, n: int, by: list[str], order: list[str]) -> DataFrame:
    """O2: the newest n rows of each key."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def sort_cues(df: DataFrame) -> DataFrame:
    """O3."""
    return df.orderBy("start", "position")


def head_n(df: DataFrame, n: int, order: str = "id") -> DataFrame:
    """O4."""
    return df.orderBy(order).limit(n)


def union_lists(*lists: DataFrame) -> DataFrame:
    """U1."""
    out = lists[0]
    for other in lists[1:]:
        out = out.unionByName(other)
    return out.distinct()


def missing_ids(expected: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """U2."""
    return expected.join(found.select(*by).distinct(), by, "left_anti")


def json_paths(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Leaves of a JSON object as ``path, value, json`` (text, and JSON with sorted keys); lists and empty objects are leaves. Each
    level is written, down to the deepest one; null and broken JSON has no leaves."""
    level = df.select(*by, F.lit("").alias("path"), F.to_json(F.try_parse_json(column)).alias("json")).filter(F.col("json").like('{"%'))
    leaves = None
    while True:
        exploded = level.select(*by, F.col("path").alias("__p"), F.parse_json("json").alias("v")).lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer()))
        path = F.concat("__p", F.when(F.col("__p") == "", "").otherwise("."), "key")
        own = staged(exploded.select(*by, path.alias("path"), F.to_json("value").alias("json")), "json-level")
        inner = F.col("json").like('{"%')
        text = F.when(F.col("json").like('"%'), F.variant_get(F.parse_json("json"), "$", "string")).otherwise(F.col("json"))
        done = own.filter(~inner).withColumn("value", text)
        leaves = done if leaves is None else leaves.unionByName(done)
        level = own.filter(inner)
        if level.isEmpty():
            return leaves


def changed_settings(before: DataFrame, after: DataFrame, by: list[str], column: str = "settings") -> DataFrame:
    """Dotted paths whose value differs between two JSON objects, at any depth; the order of keys doesn't matter, a null
    is the same as no value."""
    side = lambda df, name: json_paths(df, by, column).filter("json <> 'null'").withColumnsRenamed({"value": name, "json": f"__{name}"})
    both = side(before, "old").join(side(after, "new"), [*by, "path"], "full")
    return both.filter(~F.col("__old").eqNullSafe(F.col("__new"))).drop("__old", "__new")
