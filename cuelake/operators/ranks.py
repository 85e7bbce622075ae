"""Exact values at given ranks of a group, without sorting the group (A1, A2).

A first aggregate gives each group's count and, from its mergeable quantile sketch, an interval around each rank. Rows
then become counts: those below the interval are one count, those inside a count for each value, both combined
before the shuffle. Only the values inside an interval, about a thousandth of a large group, are put in order, with running
sums of their counts. A group of up to ``SMALL`` rows is its own interval. Intervals of up to ``FEW`` groups, which are counted,
are broadcast, so that rows of a few large groups stay where they are; more are met by a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Rows of a group of which all values are put in order; the sketch's accuracy; the interval's half width in its errors.
SMALL, ACCURACY, ERRORS = 10_000, 10_000, 4
#: Groups whose intervals are broadcast at most.
FEW = 20_000


def with_ranks(df: DataFrame, value: str, by: list[str], ranks: dict[str, tuple[float, Callable[[Column], Column]]], aggregates: dict[str, Column] | None = None, accuracy: int = ACCURACY, small: int = SMALL) -> DataFrame:
    """Per key of ``by``: ``n`` (values that aren't null), ``aggregates``, and a double for each of ``ranks``, the value
    at a place from 0 that a function of n names, near the given share of n. Null in groups without values; null keys
    are keys; NaN is above all numbers; without keys there is one row, even of an empty table."""
    v = F.col(value).cast("double")
    rows = df.select(*by, v.alias("__v"))
    margin = ERRORS / accuracy
    shares = [min(1.0, max(0.0, p + side)) for p, _ in ranks.values() for side in (-margin, margin)]
    sketch = F.percentile_approx(F.when(F.isnan("__v"), math.inf).otherwise(F.col("__v")), F.array(*[F.lit(s) for s in shares]), accuracy)
    groups = df.withColumn("__v", v).groupBy(*by).agg(F.count("__v").alias("n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), sketch.alias("__q"), *[c.alias(k) for k, c in (aggregates or {}).items()])
    groups = staged(groups, "rank-groups")  # a row for each group, used twice
    near = lambda k, p: (  # noqa: E731  the interval of rank k
        F.when((F.col("n") <= small) | F.lit(p - margin <= 0), F.col("__min")).otherwise(F.col("__q")[2 * k]),
        F.when((F.col("n") <= small) | F.lit(p + margin >= 1) | (F.col("__q")[2 * k + 1] == math.inf), F.col("__max")).otherwise(F.col("__q")[2 * k + 1]),
    )
    wanted = []
    for k, (p, place) in enumerate(ranks.values()):
        low, high = near(k, p)
        wanted.append(F.struct(F.lit(k).alias("k"), place(F.col("n")).cast("long").alias("at"), low.alias("low"), high.alias("high")))
    keys = [f"__k{i}" for i in range(len(by))]
    spans = groups.filter("n > 0").select(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.array(*wanted).alias("__w"))
    same = [F.col(b).eqNullSafe(F.col(k)) for b, k in zip(by, keys)] or [F.lit(True)]
    match = same[0]
    for c in same[1:]:
        match = match & c
    spans = F.broadcast(spans) if not by or groups.count() <= FEW else spans
    each = rows.filter("__v is not null").join(spans, match).select(*keys, "__v", F.explode("__w").alias("w")).filter("__v <= w.high")
    inside = F.when(F.col("__v") >= F.col("w.low"), F.col("__v"))
    counts = each.groupBy(*keys, F.col("w.k").alias("__k"), F.col("w.at").alias("__at"), inside.alias("__v")).agg(F.count("*").alias("__c"))
    up_to = F.sum("__c").over(Window.partitionBy(*keys, "__k", "__at").orderBy(F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    found = counts.withColumn("__s", up_to).filter("__s > __at and __s - __c <= __at and __v is not null")
    picked = found.groupBy(*keys).agg(*[F.max(F.when(F.col("__k") == k, F.col("__v"))).alias(name) for k, name in enumerate(ranks)])
    out = groups.drop("__min", "__max", "__q")
    out = out.join(picked, match, "left") if by else out.crossJoin(F.broadcast(picked))  # one row each
    missed = F.raise_error(F.lit("a rank lies outside the interval of the quantile sketch"))
    exact = {name: F.when((F.col("n") > 0) & F.col(name).isNull(), missed).otherwise(F.col(name)) for name in ranks}
    return out.withColumns(exact).drop(*keys)


def nearest(p: float) -> tuple[float, Callable[[Column], Column]]:
    """Rank ceil(p n), as percentile_disc has it."""
    return p, lambda n: F.greatest(F.ceil(F.lit(p) * n) - 1, F.lit(0))
