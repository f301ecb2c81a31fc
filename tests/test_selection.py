"""Percentiles by ranges and counts against Spark's own aggregate, which holds all distinct values."""

import random

import pytest
from pyspark.sql import functions as F

from tidebar.operators import selection

SHARES = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p90": 0.9, "p100": 1.0}


@pytest.mark.parametrize("ranges", [3, 1024])
def test_percentiles(spark, monkeypatch, ranges):
    monkeypatch.setattr(selection, "RANGES", ranges)
    rng = random.Random(8)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(2000)] + [("same", 7.0)] * 900 + [("one", 3.5)] + [("none", None)]
    rows += [("far", 10.0 ** rng.randrange(-300, 300)) for _ in range(300)] + [("ties", float(rng.randrange(4))) for _ in range(701)] + [("ties", None)] * 5 + [("two", -1.0), ("two", 4.0)]
    df = spark.createDataFrame(rows, "key string, v double")
    want = df.groupBy("key").agg(*[F.expr(f"percentile(v, {p})").alias(n) for n, p in SHARES.items()])
    got = selection.percentiles(df, ["key"], "v", SHARES)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_two_keys_and_empty(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("a"), (F.col("id") % 2).alias("b"), (F.col("id") * F.col("id") % 101).alias("v"))
    want = df.groupBy("a", "b").agg(F.expr("percentile(v + 1, 0.3)").alias("q"))
    assert sorted(map(tuple, selection.percentiles(df, ["a", "b"], "v + 1", {"q": 0.3}).collect())) == sorted(map(tuple, want.collect()))
    assert selection.percentiles(df.limit(0), ["a", "b"], "v", {"q": 0.3}).count() == 0


def test_no_aggregate_holds_values(spark):
    plan = selection.percentiles(spark.range(10).withColumn("k", F.col("id") % 2), ["k"], "id", SHARES)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_list" not in plan


@pytest.mark.parametrize("limit", [0, 1, 700, 10**6])
def test_short_and_long_keys(spark, monkeypatch, limit):
    """The same percentiles, whichever keys are sorted and whichever counted."""
    monkeypatch.setattr(selection, "SORTED", limit / selection.RANGES)
    rows = [(k, float(i * 7919 % 1009 - 500) if i % 9 else None) for k, n in (("a", 1), ("b", 2), ("c", 40), ("d", 800), ("e", 3000)) for i in range(n)] + [("zero", -0.0)]
    df = spark.createDataFrame(rows, "key string, v double")
    want = df.groupBy("key").agg(*[F.expr(f"percentile(v, {p})").alias(n) for n, p in SHARES.items()])
    assert sorted(map(tuple, selection.percentiles(df, ["key"], "v", SHARES).collect())) == sorted(map(tuple, want.collect()))


def test_short_keys_make_no_row_a_value(spark, monkeypatch):
    """400 keys of 50 values: no counts of ranges, which would be nearly a row a value, are shuffled or sorted."""
    df = spark.range(20_000).select((F.col("id") % 400).alias("k"), (F.col("id") * 7919 % 20_011).alias("v"))
    got = selection.percentiles(df, ["k"], "v", {"q": 0.3})
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert not [line for line in plan.splitlines() if "HashAggregate" in line and "range" in line]
