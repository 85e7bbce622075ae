"""Exact ranks against sorted lists, with intervals that are narrow."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cuelake.operators import ranks, stats


def rows():
    r = random.Random(1)
    kinds = {"even": lambda: r.random(), "far": lambda: math.exp(r.gauss(0, 30)), "same": lambda: 5.0, "few": lambda: float(r.randrange(3)), "late": lambda: 1.7e12 + r.randrange(50_000), None: lambda: r.gauss(0, 1)}
    out = [(k, None if r.random() < 0.02 else f()) for k, f in kinds.items() for _ in range(3000)]
    return out + [("one", 7.0), ("none", None), ("nan", float("nan")), ("nan", 1.0)]


@pytest.mark.parametrize("small", [0, 10_000])
def test_against_sorted_lists(spark, small):
    data = rows()
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    wanted = {"p0": (0.0, lambda n: F.lit(0)), "p1": ranks.nearest(0.01), "p50": ranks.nearest(0.5), "p95": (0.95, lambda n: stats.rank_index("linear", 0.95, n)), "p100": (1.0, lambda n: n - 1)}
    found = {r.k: r for r in ranks.with_ranks(df, "v", ["k"], wanted, {"all": F.count("*")}, accuracy=200, small=small).collect()}
    assert set(found) == {k for k, _ in data}
    for k, r in found.items():
        values = sorted((v for key, v in data if key == k and v is not None), key=lambda v: (v != v, v))
        n = len(values)
        assert (r.n, r["all"]) == (n, sum(key == k for key, _ in data))
        at = {"p0": 0, "p1": max(0, math.ceil(0.01 * n) - 1), "p50": max(0, math.ceil(0.5 * n) - 1), "p95": math.floor(0.95 * (n - 1) + 0.5), "p100": n - 1}
        for name, i in at.items():
            want = values[i] if n else None
            assert r[name] == want or (want is not None and want != want and r[name] != r[name]), (k, name)


def test_without_keys_and_rows(spark):
    df = spark.createDataFrame([(1, float(v)) for v in range(1, 101)], "k int, v double")
    row = stats.summary(df, "v").first()
    assert (row.n, row.min, row.p50, row.p95, row.p99, row.max, row.mean) == (100, 1, 50, 95, 99, 100, 50.5)
    assert tuple(stats.summary(df.limit(0), "v").first()) == (0, 0, 0, 0, 0, 0, 0, 0)
    assert stats.summary(df.limit(0), "v", ["k"]).count() == 0 and stats.rank_percentiles(df.limit(0), "v", ["k"], "nearest", {"p50": 0.5}).count() == 0


def test_no_window_holds_a_group(spark):
    """Windows stand above the counts of values, never above the rows."""
    df = spark.range(100_000).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v"))
    out = ranks.with_ranks(df, "v", ["k"], {"p50": ranks.nearest(0.5)})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Aggregate [", plan.index("Window")) and "percentile_disc" not in plan
    assert sorted((r.k, r.p50) for r in out.collect()) == [(0, 49998.0), (1, 49999.0)]


@pytest.mark.parametrize("few", [0, 20_000])
def test_large_groups_stay_where_they_are(spark, monkeypatch, few):
    """No row is sent by the key of a large group: the intervals of a few groups are broadcast, without a size that the planner guesses."""
    monkeypatch.setattr(ranks, "FEW", few)
    df = spark.range(60_000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = ranks.with_ranks(df, "v", ["k"], {"p50": ranks.nearest(0.5)}).select("k", "p50")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == (few > 0)
        assert sorted(map(tuple, out.collect())) == [(0, 29997.0), (1, 29998.0), (2, 29999.0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
