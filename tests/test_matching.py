"""Matches in time against plain double loops, with dense ties and a key that holds half of all rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidebar.operators import matching

ZERO = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module", params=[60, 200_000])
def sides(request):
    rng = random.Random(request.param)
    key = lambda: "hot" if rng.random() < 0.5 else rng.choice("abc")
    time = lambda: rng.randrange(request.param)
    left = [(i, key(), time(), rng.randrange(9) / 4) for i in range(300)]
    right = [(1000 + i, key(), time(), rng.randrange(9) / 4) for i in rng.sample(range(400), 400)]
    return left, right


def frames(spark, sides):
    at = F.timestamp_micros(F.col("t") * 1_000_000 + 1_704_067_200_000_000)
    return (spark.createDataFrame(rows, f"{name} long, k string, t long, price double").withColumn("ts", at).drop("t") for rows, name in zip(sides, ("id", "other")))


@pytest.mark.parametrize("seconds", [0, 3, 5000])
def test_nearest(spark, sides, seconds):
    got = {r.id: (r.other, r.gap) for r in matching.nearest(*frames(spark, sides), ["k"], seconds, "id", "other").collect()}
    for i, k, t, _ in sides[0]:
        near = [(abs(t - u), o) for o, q, u, _ in sides[1] if q == k and abs(t - u) <= seconds]
        assert got[i] == ((min(near)[1], min(near)[0]) if near else (None, None))


@pytest.mark.parametrize("seconds", [1, 4, 5000])
def test_first_within(spark, sides, seconds):
    got = {r.id: r.other for r in matching.first_within(*frames(spark, sides), ["k"], seconds, "id", "other").collect()}
    want = {i: min((o for o, q, u, _ in sides[1] if q == k and abs(t - u) < seconds), default=None) for i, k, t, _ in sides[0]}
    assert got == {i: o for i, o in want.items() if o is not None}


@pytest.mark.parametrize("seconds,weight", [(1, 0.0), (40, 100.0), (5000, 2.0)])
def test_least_score(spark, sides, seconds, weight):
    got = {r.id: (r.score, r.other) for r in matching.least_score(*frames(spark, sides), ["k"], seconds, weight, "id", "other").collect()}
    want = {i: min(((abs(t - u) + abs(p - v) * weight, o) for o, q, u, v in sides[1] if q == k and abs(t - u) <= seconds), default=None) for i, k, t, p in sides[0]}
    assert got == {i: m for i, m in want.items() if m}


def test_empty_sides(spark, sides):
    left, right = frames(spark, sides)
    assert matching.nearest(left, right.limit(0), ["k"], 5, "id", "other").filter("other is null").count() == len(sides[0])
    assert matching.nearest(left.limit(0), right, ["k"], 5, "id", "other").count() == 0
    assert matching.first_within(left.limit(0), right, ["k"], 5, "id", "other").count() == 0
    assert matching.least_score(left, right.limit(0), ["k"], 5, 1.0, "id", "other").count() == 0


def test_two_candidates_a_row(spark):
    """100 left rows among 10,000 right rows of one second: no operator of the plan makes a row a pair."""
    rows = spark.range(10_000).select(F.col("id").alias("other"), F.lit("a").alias("k"), F.timestamp_micros(F.col("id") * 100).alias("ts"))
    asked = spark.range(100).select("id", F.lit("a").alias("k"), F.timestamp_micros(F.col("id") * 10_000 + 30).alias("ts"))
    df = matching.nearest(asked, rows, ["k"], 60, "id", "other")
    assert {r.id: r.other for r in df.collect()} == {i: i * 100 for i in range(100)}
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()


def test_blocks_are_swept_together(spark):
    """3,000 keys cost a few calls of Python, not one each; batches end within blocks and between them; null keys match nothing."""
    rows = spark.range(30_000).select(
        F.col("id").alias("other"), F.when(F.col("id") % 10 > 0, F.col("id") % 3000).alias("k"), F.timestamp_micros(F.col("id") * 1_000_003 % 777_000_000).alias("ts"), (F.col("id") % 7 / 4).alias("price")
    )
    asked = rows.filter("other % 4 = 1 or other % 50 = 0").withColumnRenamed("other", "id").withColumn("ts", F.col("ts") + F.expr("interval 1 second"))
    df = matching.least_score(asked, rows, ["k"], 90, 3.0, "id", "other")
    assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()
    pairs = asked.join(rows.toDF("other", "k", "ts2", "price2"), "k").withColumn("gap", F.abs(F.unix_micros("ts") - F.unix_micros("ts2")) / 1e6).filter("gap <= 90")
    pairs = pairs.select("id", F.struct(F.expr("gap + abs(price - price2) * 3.0D").alias("score"), "other").alias("m"))
    want = {r.id: tuple(r.m) for r in pairs.groupBy("id").agg(F.min("m").alias("m")).collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("7", "1000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert {r.id: (r.score, r.other) for r in df.select("*").collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert want


def test_differences(spark):
    """Counts of a full outer join, with repeated keys and nulls, without one."""
    rng = random.Random(3)
    some = lambda n: [(rng.choice([1, 2, 3, None]), rng.choice(["x", "y", "z", "only" + str(n), None])) for _ in range(n)]
    a, e = (spark.createDataFrame(some(n), "k int, act string") for n in (30, 50))
    got = matching.differences(a, e, ["k", "act"])
    j = a.withColumn("a", F.lit(1)).join(e.withColumn("e", F.lit(1)), ["k", "act"], "full_outer")
    want = j.groupBy("k", "act", F.expr("case when a is null then 'expected only' when e is null then 'actual only' else 'both' end").alias("side")).agg(F.count("*").alias("rows"))
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(got.select(*want.columns)) == plain(want) and len(plain(want)) > 12
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Join" not in plan and "Sort" not in plan
