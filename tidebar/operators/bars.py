"""Candles: building, numbering, deduplicating, splitting and checking them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .selection import percentiles

#: Minutes of each timeframe.
MINUTES = {"M1": 1, "M5": 5, "M15": 15, "M30": 30, "H1": 60, "H4": 240, "D": 1440, "W": 10080}


#: Bars of a block in which the windows of ``in_blocks`` run.
BLOCK = 16_384


def by_bar(*keys: str):
    """Window of one instrument in bar order; inside ``in_blocks``, of one block of bars of it."""
    return Window.partitionBy(*(keys or ("sym",))).orderBy("bar")


def in_blocks(bars: DataFrame, before: int, f: Callable[[DataFrame], DataFrame], after: int = 0) -> DataFrame:
    """``f(bars)`` where f looks back at most ``before`` bars and ahead at most ``after``, without a task for a whole instrument.

    Each bar goes to its block and, as halo, to the blocks that look at it. Inside f, ``sym`` is a
    struct of instrument and block, so windows by ``sym`` stay within a block. f keeps sym and bar; of its rows, those of
    a block's own bars remain. Within another ``in_blocks``, f just runs; the outer one reaches far enough.
    """
    if isinstance(bars.schema["sym"].dataType, T.StructType):
        return f(bars)
    block = lambda c: F.floor(c / BLOCK).cast("int")
    part = F.explode(F.sequence(block(F.greatest(F.col("bar") - after, F.lit(0))), block(F.col("bar") + before)))
    x = bars.withColumn("_part", part).withColumn("sym", F.struct("sym", "_part")).drop("_part")
    y = f(x)
    return y.filter(block(F.col("bar")) == F.col("sym._part")).withColumn("sym", F.col("sym.sym"))


def candles(ticks: DataFrame, width: str, seq: str = "seq") -> DataFrame:
    """Open, high, low, close and count of the ticks of each window of ``width``; windows without ticks have no row.

    Ticks of one time are ordered by ``seq``. Combined on the map side, one shuffle by instrument and window.
    """
    first = F.struct("ts", seq)
    return ticks.groupBy("sym", F.window("ts", width).alias("w")).agg(
        F.min_by("price", first).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", first).alias("close"), F.count("*").alias("volume"),
    ).select("sym", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def coarser(bars: DataFrame, width: str) -> DataFrame:
    """Candles of a longer timeframe from candles."""
    return bars.groupBy("sym", F.window("ts", width).alias("w")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
    ).select("sym", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def weekly(bars: DataFrame) -> DataFrame:
    """Weekly candles labelled by the Sunday that ends the week."""
    sunday = F.date_add(F.to_date("ts"), 6 - F.weekday("ts"))
    return bars.groupBy("sym", sunday.alias("week")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
    )


def numbered(bars: DataFrame) -> DataFrame:
    """Adds ``bar``: 0 for the first row of each instrument, and on in time.

    Rows are numbered within a month; the counts of the months before, one row each, give its start.
    """
    x = bars.withColumn("_month", F.date_trunc("month", "ts"))
    so_far = F.sum("_n").over(Window.partitionBy("sym").orderBy("_month").rowsBetween(Window.unboundedPreceding, -1))
    start = x.groupBy("sym", "_month").agg(F.count("*").alias("_n")).select("sym", "_month", F.coalesce(so_far, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("sym", "_month").orderBy("ts"))
    return x.withColumn("bar", place).join(start, ["sym", "_month"]).withColumn("bar", (F.col("_start") + F.col("bar") - 1).cast("int")).drop("_month", "_start")


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: that of the greatest ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: that of the least ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def between(rows: DataFrame, start: str | Column, end: str | Column, ts: str = "ts") -> DataFrame:
    """Rows with start <= ts < end; reaches the file scan as a pushed filter."""
    lit = lambda x: F.lit(x).cast("timestamp") if isinstance(x, str) else x
    return rows.filter((F.col(ts) >= lit(start)) & (F.col(ts) < lit(end)))


def trailing(rows: DataFrame, interval: str) -> DataFrame:
    """Rows of each instrument not older than ``interval`` before its last."""
    last = rows.groupBy("sym").agg(F.max("ts").alias("_last"))
    return rows.join(last, "sym").filter(F.col("ts") >= F.col("_last") - F.expr(f"interval {interval}")).drop("_last")


def split(bars: DataFrame, ratio: float) -> DataFrame:
    """Adds ``part``: 'back' for the first int(n * ratio) bars of an instrument, else 'forward'."""
    n = bars.groupBy("sym").agg(F.count("*").alias("_n"))
    return bars.join(n, "sym").withColumn("part", F.when(F.col("bar") < F.floor(F.col("_n") * ratio), "back").otherwise("forward")).drop("_n")


def holdout_ratio(months: float, years: float) -> float:
    """Share of bars to train on: 1 - months / (12 * years), kept within 0.5 and 0.9."""
    return max(0.5, min(0.9, 1 - months / (years * 12)))


def gaps(bars: DataFrame, minutes: int, factor: float = 3.0) -> DataFrame:
    """Steps of over ``factor`` bars: sym, ts, hours, weekend (from a Friday to a Sunday, or from a Friday for over 48 hours)."""
    before = F.lag("ts").over(by_bar())
    step = in_blocks(bars, 1, lambda x: x.withColumn("before", before)).filter("before is not null").withColumn("seconds", F.col("ts").cast("long") - F.col("before").cast("long"))
    friday = F.weekday("before") == 4
    return step.filter(F.col("seconds") > factor * minutes * 60).select("sym", "ts", (F.col("seconds") / 3600.0).alias("hours"), (friday & ((F.weekday("ts") == 6) | (F.col("seconds") > 48 * 3600))).alias("weekend"))


def anomalies(bars: DataFrame) -> DataFrame:
    """Bars whose range is out of order: high below low, no range, or over ten times the instrument's median range."""
    typical = percentiles(bars, ["sym"], "high - low", {"typical": 0.5})
    size = F.col("high") - F.col("low")
    kind = F.when((F.col("typical") > 0) & (size > 10 * F.col("typical")), "huge_range").when(size == 0, "zero_range").when(size < 0, "high_low_violation")
    return bars.join(typical, "sym").withColumn("anomaly", kind).filter("anomaly is not null").drop("typical")


def score(issues: Column, warnings: Column) -> Column:
    return F.greatest(F.lit(0), 100 - 20 * issues - 5 * warnings)


def quality(bars: DataFrame, minutes: int, minimum: int = 100) -> DataFrame:
    """Per instrument: counts of rows, nulls, zeros, gaps and anomalies, a score from 100 down and whether it passes."""
    prices = ("open", "high", "low", "close")
    null = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in prices), F.lit(0))
    zero = sum((F.when(F.col(c) == 0, 1).otherwise(0) for c in prices), F.lit(0))
    base = bars.groupBy("sym").agg(F.count("*").alias("bars"), F.sum(null).alias("nulls"), F.sum(zero).alias("zeros"))
    gap = gaps(bars, minutes).groupBy("sym").agg(F.count_if(~F.col("weekend")).alias("gaps"), F.count_if("weekend").alias("weekends"))
    odd = anomalies(bars).groupBy("sym").agg(F.count("*").alias("anomalies"))
    out = base.join(gap, "sym", "left").join(odd, "sym", "left").na.fill(0, ["gaps", "weekends", "anomalies"])
    issues = (F.col("nulls") > 0).cast("int") + (F.col("zeros") > 0).cast("int") + (F.col("bars") < minimum).cast("int")
    warnings = (F.col("gaps") > 0).cast("int") + (F.col("anomalies") > 0).cast("int")
    return out.withColumn("score", score(issues, warnings)).withColumn("passed", (F.col("score") >= 50) & (F.col("bars") >= minimum))
