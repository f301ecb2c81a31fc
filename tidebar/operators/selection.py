"""Exact percentiles: short keys are sorted, long ones narrowed to ranges of values and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges into which the values of a key, and then those of a range, are cut.
RANGES = 1024
#: Keys of up to so many values a range are sorted; counting would make nearly a row a value of them.
SORTED = 16


def _range_of(value: Column, low: Column, high: Column) -> Column:
    """Number of the range a value falls into; it grows with the value."""
    return F.when(high > low, F.least(F.floor((value - low) / ((high - low) / RANGES)), F.lit(RANGES - 1))).otherwise(0).cast("int")


def _located(wanted: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """For each wanted place (``by``, at) the range of ``ranges`` (``by``, range, n, low, high) that holds it; ``at`` then counts from its start."""
    w = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    placed = ranges.withColumn("_start", F.coalesce(F.sum("n").over(w), F.lit(0)))
    found = wanted.join(placed, by).filter((F.col("at") >= F.col("_start")) & (F.col("at") < F.col("_start") + F.col("n")))
    return found.withColumn("at", F.col("at") - F.col("_start")).drop("_start", "n")


def percentiles(rows: DataFrame, keys: list[str], value: Column | str, shares: dict[str, float]) -> DataFrame:
    """A row for each key with the named percentiles, interpolated between the two values around their place; null without values.

    Keys of up to ``SORTED * RANGES`` values are sorted, many to a task. The values of a longer key are counted in ranges between its
    least and greatest one, on the map side first; the range that holds a place is cut in ranges again; only values of that range of a range are then
    counted one by one. Keys must not be null; null values don't count. Equal values of a long key cost one row however many they are. No buffer
    holds the values of a long key: a task keeps at most ``RANGES`` counts of it. Where nearly all values lie in one of the million
    ranges, that one is sorted by distinct value, which spills. The list of long keys, at most a row for as many values, is broadcast.
    """
    x = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], ((F.expr(value) if isinstance(value, str) else value).cast("double") + 0.0).alias("v"))
    by = [f"_k{i}" for i in range(len(keys))]
    span = x.groupBy(*by).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("total"))
    long = span.filter(F.col("total") > SORTED * RANGES)
    asked = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("total") - 1)).alias("place")) for name, p in shares.items()])
    # short keys: the places among sorted values
    w = Window.partitionBy(*by).orderBy("v")
    short = x.join(F.broadcast(long.select(*by)), by, "left_anti").filter("v is not null")
    short = short.select(*by, "v", (F.row_number().over(w) - 1).alias("rank"), F.count("v").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    short = short.select(*by, "v", "rank", F.explode(F.filter(asked, lambda q: F.col("rank").isin(F.floor(q["place"]), F.ceil(q["place"])))).alias("asked"))
    short = short.select(*by, F.col("asked.name").alias("name"), F.col("asked.place").alias("place"), "v", "rank")
    # long keys: ranges
    first = x.join(F.broadcast(long), by).filter("v is not null").withColumn("range", _range_of(F.col("v"), F.col("low"), F.col("high"))).select(*by, "v", "range")
    counted = lambda df, by: df.groupBy(*by, "range").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    wanted = long.select(*by, F.explode(asked).alias("asked")).select(*by, "asked.name", "asked.place")
    wanted = wanted.withColumn("at", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place"))))).withColumn("rank", F.col("at"))
    one = _located(wanted, counted(first, by), by).withColumnRenamed("range", "range1")
    # the ranges that hold a place, once each, and the values in them
    inside = first.withColumnRenamed("range", "range1").join(one.select(*by, "range1", "low", "high").distinct(), [*by, "range1"])
    second = inside.withColumn("range", _range_of(F.col("v"), F.col("low"), F.col("high"))).select(*by, "range1", "v", "range")
    two = _located(one.drop("low", "high"), counted(second, [*by, "range1"]), [*by, "range1"]).drop("low", "high")
    cell = [*by, "range1", "range"]
    kept = second.join(two.select(*cell).distinct(), cell).groupBy(*cell, "v").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*cell).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = two.join(kept.withColumn("_start", before), cell).filter((F.col("at") >= F.col("_start")) & (F.col("at") < F.col("_start") + F.col("n")))
    found = found.select(*short.columns).unionByName(short)
    low, high = F.min_by("v", "rank"), F.max_by("v", "rank")
    lower, upper = F.floor("place"), F.ceil("place")
    found = found.groupBy(*by, "name", "place").agg(low.alias("low"), high.alias("high"))
    between = F.when(lower == upper, F.col("low")).when(F.col("low") == F.col("high"), F.col("low")).otherwise((upper - F.col("place")) * F.col("low") + (F.col("place") - lower) * F.col("high"))
    values = found.select(*by, "name", between.alias("v")).groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares])
    return span.select(*by).join(values, by, "left").select(*[F.col(b).alias(k) for b, k in zip(by, keys)], *shares)
