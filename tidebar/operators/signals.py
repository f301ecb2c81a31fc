"""Entry signals: bar, direction (1 long, -1 short), price (the close) and what filters and stops need."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import indicators as I
from .bars import BLOCK, by_bar, in_blocks
from .scans import scan


def _before(column: str) -> Column:
    return F.lag(column).over(by_bar())


def _cross(bars: DataFrame, long: Column, short: Column, *extra: Column | str) -> DataFrame:
    """Rows where a side triggers; a bar that triggers both is long."""
    d = F.when(long, 1).when(short, -1)
    return bars.withColumn("direction", d).filter("direction is not null").select("sym", "bar", "ts", "direction", F.col("close").alias("price"), *extra)


def donchian_variants(bars: DataFrame, periods: list[int]) -> DataFrame:
    """Close beyond the channel of the n bars before, with the previous close not beyond the current channel, for each n of ``periods``.

    Signals are told apart by channel_period; all channels are windows over one sort.
    """

    def found(x: DataFrame) -> DataFrame:
        close, prev = F.col("close"), F.col("_prev")
        x = x.withColumn("_prev", _before("close"))
        sides = []
        for n in periods:
            up, low = I.donchian(n)
            x = x.withColumn(f"_up{n}", up).withColumn(f"_low{n}", low)
            up, low = F.col(f"_up{n}"), F.col(f"_low{n}")
            side = F.when((close > up) & (prev <= up), 1).when((close < low) & (prev >= low), -1)
            sides.append(F.struct(side.alias("direction"), F.lit(n).alias("channel_period"), (up - low).alias("channel_width")))
        x = x.select("sym", "bar", "ts", "close", F.explode(F.array(*sides)).alias("s")).filter("s.direction is not null")
        return x.select("sym", "bar", "ts", "s.direction", F.col("close").alias("price"), "s.channel_period", "s.channel_width")

    return in_blocks(bars, max(periods) + 1, found)


def donchian(bars: DataFrame, n: int) -> DataFrame:
    return donchian_variants(bars, [n])


def bollinger(bars: DataFrame, n: int, width: float) -> DataFrame:
    """Close outside the bands, previous close inside its own; from bar max(n, 100) + 1."""

    def found(x: DataFrame) -> DataFrame:
        mid, up, low = I.bollinger("close", n, width)
        x = x.withColumn("mid", mid).withColumn("upper", up).withColumn("lower", low)
        for c in ("close", "upper", "lower"):
            x = x.withColumn(f"_{c}", _before(c))
        inside = (F.col("_close") <= F.col("_upper")) & (F.col("_close") >= F.col("_lower")) & (F.col("bar") >= max(n, 100) + 1)
        band = F.when(F.col("mid") > 0, F.try_divide(F.col("upper") - F.col("lower"), F.col("mid"))).otherwise(0.0)
        return _cross(x, inside & (F.col("close") > F.col("upper")), inside & (F.col("close") < F.col("lower")), F.lit(n).alias("bb_period"), F.lit(width).alias("bb_std"), band.alias("bb_width"))

    return in_blocks(bars, n + 1, found)


def ema_cross(bars: DataFrame, fast: int, slow: int, *extra: Column | str) -> DataFrame:
    """Fast average crosses the slow one, both present on both bars, from bar slow + 1."""

    def found(x: DataFrame) -> DataFrame:
        x = I.ema(I.ema(x, "close", fast, "fast"), "close", slow, "slow")
        x = x.withColumn("_f", _before("fast")).withColumn("_s", _before("slow")).withColumn("separation", F.col("fast") - F.col("slow"))
        ready = F.col("bar") >= slow + 1
        return _cross(x, ready & (F.col("_f") <= F.col("_s")) & (F.col("fast") > F.col("slow")), ready & (F.col("_f") >= F.col("_s")) & (F.col("fast") < F.col("slow")), "separation", *extra)

    # crosses are few; only they are ordered for a whole instrument
    since = F.coalesce(F.col("bar") - F.lag("bar").over(by_bar()), F.lit(500))
    return in_blocks(bars, I.ema_reach(slow) + 4, found).withColumn("bars_since_last_cross", since)


def cross_features(bars: DataFrame, fast: int, slow: int, atr: int = 14) -> DataFrame:
    """Crosses of two averages with their separation, three-bar slopes and the speed of crossing, in average ranges."""
    by_atr = lambda v: F.when(F.col("atr") > 0, F.try_divide(v, F.col("atr"))).otherwise(0.0)

    def found(x: DataFrame) -> DataFrame:
        x = I.atr(I.ema(I.ema(x, "close", fast, "fast"), "close", slow, "slow"), atr)
        x = x.withColumn("_gap", F.col("fast") - F.col("slow")).withColumn("_f", _before("fast")).withColumn("_s", _before("slow"))
        x = x.withColumn("separation", by_atr(F.abs("_gap"))).withColumn("velocity", by_atr(F.col("_gap") - _before("_gap")))
        for c in ("fast", "slow"):
            x = x.withColumn(f"{c}_slope", by_atr(F.col(c) - I.lagged(c, 3)))
        ready = F.col("bar") >= slow + 1
        return _cross(x, ready & (F.col("_f") <= F.col("_s")) & (F.col("fast") > F.col("slow")), ready & (F.col("_f") >= F.col("_s")) & (F.col("fast") < F.col("slow")), "separation", "fast_slope", "slow_slope", "velocity")

    return in_blocks(bars, max(I.ema_reach(slow), I.wilder_reach(atr)) + 5, found)


def stochastic_adx(bars: DataFrame, n: int, smooth: int, d: int, adx: int) -> DataFrame:
    """%K crosses %D; carries ADX and the directional indicators for filters."""

    def found(x: DataFrame) -> DataFrame:
        x = I.adx(I.stochastic(x, n, smooth, d), adx)
        x = x.withColumn("_k", _before("k")).withColumn("_d", _before("d"))
        ready = F.col("bar") >= n + smooth + d
        return _cross(x, ready & (F.col("_k") <= F.col("_d")) & (F.col("k") > F.col("d")), ready & (F.col("_k") >= F.col("_d")) & (F.col("k") < F.col("d")), "k", "d", "adx", "plus_di", "minus_di")

    return in_blocks(bars, 2 * I.wilder_reach(adx) + n + smooth + d + 2, found)


def session_breakout(bars: DataFrame, start: int, end: int, hours: int = 6) -> DataFrame:
    """Close crosses an edge of the day's range of the hours [start, end), within ``hours`` after it, on weekdays; the first of each day and side."""
    x = bars.withColumn("day", F.to_date("ts")).withColumn("hour", F.hour("ts")).filter(F.weekday("ts") < 5)
    box = x.filter((F.col("hour") >= start) & (F.col("hour") < end)).groupBy("sym", "day").agg(F.max("high").alias("range_high"), F.min("low").alias("range_low"))
    # the bar before on weekdays lies at most a weekend back
    last = scan(x, ["sym"], ["bar"], [F.floor(F.col("bar") / BLOCK)], lasts={"_close": F.col("close")}).withColumnRenamed("_close_before", "_prev")
    y = last.join(box, ["sym", "day"]).filter((F.col("hour") >= end) & (F.col("hour") < end + hours))
    up = (F.col("close") > F.col("range_high")) & (F.col("_prev") <= F.col("range_high"))
    down = (F.col("close") < F.col("range_low")) & (F.col("_prev") >= F.col("range_low"))
    found = _cross(y, up, down, "day", "range_high", "range_low", (F.col("range_high") - F.col("range_low")).alias("range_size"))
    first = F.row_number().over(Window.partitionBy("sym", "day", "direction").orderBy("bar"))
    return found.withColumn("_n", first).filter("_n = 1").drop("_n")


def divergence(bars: DataFrame, periods: tuple[int, ...] = (7, 14, 21), strengths: tuple[int, ...] = (3, 5, 7), confirm: int = 8, nearest: int = 2, farthest: int = 120) -> DataFrame:
    """Hidden divergence of price and the mean RSI between swings that follow one another.

    A higher low in price with a lower RSI is long, a lower high with a higher RSI short. The
    signal comes ``confirm`` bars after the second swing, at that bar's close.
    """

    def found(x: DataFrame) -> DataFrame:
        for n in periods:
            x = I.rsi(x, n, f"_rsi{n}")
        x = x.withColumn("rsi", reduce(lambda a, b: a + b, [F.col(f"_rsi{n}") for n in periods]) / len(periods))
        highs, lows = zip(*(I.swings(s) for s in strengths))
        x = x.withColumn("_high", reduce(lambda a, b: a | b, highs)).withColumn("_low", reduce(lambda a, b: a | b, lows))
        x = x.withColumn("_at", F.lead("close", confirm).over(by_bar())).withColumn("_when", F.lead("ts", confirm).over(by_bar()))

        def side(flag: str, price: str, direction: int) -> DataFrame:
            s = x.filter(flag)
            w = by_bar()
            s = s.withColumn("_p", F.lag(price).over(w)).withColumn("_r", F.lag("rsi").over(w)).withColumn("bars_between", F.col("bar") - F.lag("bar").over(w))
            gap = F.col("bars_between").between(nearest, farthest)
            turn = (direction * F.col(price) > direction * F.col("_p")) & (direction * F.col("rsi") < direction * F.col("_r"))
            angle = I.slope_angle(F.col(price) - F.col("_p"), F.col("bars_between"))
            return s.filter(gap & turn & F.col("_at").isNotNull()).select("sym", (F.col("bar") + confirm).alias("bar"), F.col("_when").alias("ts"), F.lit(direction).alias("direction"), F.col("_at").alias("price"), F.col("rsi").alias("rsi_value"), F.col("_r").alias("prev_rsi"), F.abs(F.col("rsi") - F.col("_r")).alias("rsi_diff"), "bars_between", angle.alias("price_slope"))

        return side("_low", "low", 1).unionByName(side("_high", "high", -1))

    return in_blocks(bars, I.wilder_reach(max(periods)) + farthest + confirm + 2 * max(strengths), found, after=confirm + max(strengths) + 1)


def grid_fills(entries: DataFrame, bars: DataFrame, orders: list[int], step: Column, horizon: int = 499) -> DataFrame:
    """First touch of each grid level within ``horizon`` bars after its entry; levels never touched have a null fill.

    ``entries`` has sym, bar, direction and price. The range join is cut into blocks of ``horizon`` bars, so it is an
    equi-join on the block with at most two blocks for each entry.
    """
    level = entries.withColumn("level", F.explode(F.array(*map(F.lit, orders)))).withColumn("limit", F.col("price") - F.col("direction") * F.col("level") * step)
    near = level.withColumn("_block", F.explode(F.array(F.floor((F.col("bar") + 1) / horizon), F.floor((F.col("bar") + horizon) / horizon)))).distinct()
    b = bars.select("sym", F.col("bar").alias("_bar"), "high", "low", F.floor(F.col("bar") / horizon).alias("_block"))
    touched = F.when(F.col("direction") == 1, F.col("low") <= F.col("limit")).otherwise(F.col("high") >= F.col("limit"))
    hits = near.join(b, ["sym", "_block"]).filter((F.col("_bar") > F.col("bar")) & (F.col("_bar") <= F.col("bar") + horizon) & touched)
    keys = ["sym", "bar", "direction", "price", "level", "limit"]
    first = hits.groupBy(*keys).agg(F.min("_bar").alias("fill_bar"))
    return level.join(first, keys, "left").select(*keys, "fill_bar")


def on_latest(bars: DataFrame, f: Callable[[DataFrame], DataFrame], last: int, before: int) -> DataFrame:
    """Signals of the last ``last`` bars of each instrument, made from these and the ``before`` bars that they look back at."""
    end = bars.groupBy("sym").agg(F.max("bar").alias("_end"))
    x = bars.join(end, "sym").filter(F.col("bar") > F.col("_end") - last - before)
    return f(x.drop("_end")).join(end, "sym").filter(F.col("bar") > F.col("_end") - last).drop("_end")
