"""Indicators over the bars of an instrument.

Windowed ones are plain window columns. Recursive ones (exponential and Wilder averages) are
linear: y = a * y_before + u. So y is a sum of u weighted by powers of a, which a window sums
chunk by chunk; of what lies before a chunk, the one before it carries all that a double can hold.
What is bounded in its look back runs in blocks of bars with a halo (``bars.in_blocks``), so no
task needs all bars of an instrument. Before its first full frame, an indicator is null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import by_bar, in_blocks

#: A chunk of a recursion is so long that its first value weighs exp(-FADED) at its end.
FADED = 45.0


def frame(n: int, *keys: str):
    """The last n bars, the current one included."""
    return by_bar(*keys).rowsBetween(-(n - 1), 0)


def full(n: int, value: Column) -> Column:
    """``value`` from the n-th bar on."""
    return F.when(F.col("bar") >= n - 1, value)


def sma(column: str, n: int) -> Column:
    return full(n, F.avg(column).over(frame(n)))


def bollinger(column: str, n: int, width: float) -> tuple[Column, Column, Column]:
    """Middle, upper and lower band, by the population deviation."""
    mid, dev = F.avg(column).over(frame(n)), F.stddev_pop(column).over(frame(n))
    return full(n, mid), full(n, mid + width * dev), full(n, mid - width * dev)


def donchian(n: int) -> tuple[Column, Column]:
    """Highest high and lowest low of the n bars before the current one."""
    past = by_bar().rowsBetween(-n, -1)
    ready = F.col("bar") >= n
    return F.when(ready, F.max("high").over(past)), F.when(ready, F.min("low").over(past))


def true_range() -> Column:
    before = F.lag("close").over(by_bar())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def stochastic(bars: DataFrame, n: int, smooth: int, d: int) -> DataFrame:
    """Adds k and d: smoothed %K and its average; raw %K is 50 where the range is flat and 0 before
    the first full frame, and the averages run over those zeros."""
    low, high = F.min("low").over(frame(n)), F.max("high").over(frame(n))
    raw = F.when(F.col("bar") < n - 1, 0.0).when(high > low, F.try_divide((F.col("close") - low) * 100, high - low)).otherwise(50.0)
    k = bars.withColumn("_raw", raw).withColumn("k", F.when(F.col("bar") >= smooth - 1, F.avg("_raw").over(frame(smooth))).otherwise(0.0))
    return k.withColumn("d", F.when(F.col("bar") >= d - 1, F.avg("k").over(frame(d))).otherwise(0.0)).drop("_raw")


def directional_moves() -> tuple[Column, Column]:
    """+DM and -DM: at most one of them is above 0."""
    up = F.col("high") - F.lag("high").over(by_bar())
    down = F.lag("low").over(by_bar()) - F.col("low")
    return F.when((up > down) & (up > 0), up).otherwise(0.0), F.when((down > up) & (down > 0), down).otherwise(0.0)


def swings(strength: int, tolerance: int | None = None) -> tuple[Column, Column]:
    """Whether a bar is a swing high, or low: of ``strength`` pairs of bars around it, at most ``tolerance`` reach as far.

    The default tolerance is max(1, strength // 4); 0 is strict.
    """
    allowed = max(1, strength // 4) if tolerance is None else tolerance
    w = by_bar()
    inside = (F.col("bar") >= strength) & F.lead("bar", strength).over(w).isNotNull()

    def violated(column: str, sign: int) -> Column:
        here = sign * F.col(column)
        pairs = (F.when((sign * F.lag(column, k).over(w) >= here) | (sign * F.lead(column, k).over(w) >= here), 1).otherwise(0) for k in range(1, strength + 1))
        return sum(pairs, F.lit(0))

    return inside & (violated("high", 1) <= allowed), inside & (violated("low", -1) <= allowed)


def chunk(a: float) -> int:
    """Bars after which a value's weight in y = a * y_before + u is below what a double holds."""
    return 1 if a <= 0 else math.ceil(FADED / -math.log(a))


def ema_reach(n: int) -> int:
    """Bars that an exponential average of n looks back."""
    return 2 * chunk(1 - 2 / (n + 1)) + n


def wilder_reach(n: int) -> int:
    return 2 * chunk(1 - 1 / n) + n


def recursion(bars: DataFrame, u: Column, a: float, seed_bar: int, seed: Column, out: str) -> DataFrame:
    """Adds ``out``: seed at bar ``seed_bar``, then a * before + u; null earlier.

    ``seed`` may be a window column. Looks back two chunks of ``a``.
    """
    size = chunk(a)
    start = F.when(F.col("bar") == seed_bar, seed).when(F.col("bar") > seed_bar, u)
    x = bars.withColumn("_u", F.coalesce(start, F.lit(0.0))).withColumn("_chunk", F.floor(F.col("bar") / size))
    if a <= 0:
        return x.withColumn(out, F.when(F.col("bar") >= seed_bar, F.col("_u"))).drop("_u", "_chunk")
    place = (F.col("bar") - F.col("_chunk") * size).cast("double")
    inside = F.sum(F.col("_u") * F.pow(F.lit(a), -place)).over(by_bar("sym", "_chunk").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_own", inside * F.pow(F.lit(a), place))
    before = F.last(F.when(place == size - 1, F.col("_own")), ignorenulls=True).over(by_bar().rowsBetween(Window.unboundedPreceding, -1))
    value = F.col("_own") + F.coalesce(before, F.lit(0.0)) * F.pow(F.lit(a), place + 1)
    return x.withColumn(out, F.when(F.col("bar") >= seed_bar, value)).drop("_u", "_chunk", "_own")


def ema(bars: DataFrame, column: str, n: int, out: str, seeded_by_mean: bool = True) -> DataFrame:
    """Exponential average with weight 2 / (n + 1), from the mean of the first n bars, or from the first value."""
    k = 2 / (n + 1)
    first, seed = (n - 1, F.avg(column).over(frame(n))) if seeded_by_mean else (0, F.col(column))
    return in_blocks(bars, ema_reach(n), lambda x: recursion(x, F.col(column) * k, 1 - k, first, seed, out))


def wilder(bars: DataFrame, column: str, n: int, out: str, first: int = 0) -> DataFrame:
    """Wilder's average, from the mean of bars first .. first + n - 1."""
    mean = F.avg(column).over(frame(n))
    return in_blocks(bars, wilder_reach(n), lambda x: recursion(x, F.col(column) / n, 1 - 1 / n, first + n - 1, mean, out))


def atr(bars: DataFrame, n: int, out: str = "atr") -> DataFrame:
    return in_blocks(bars, wilder_reach(n) + 1, lambda x: wilder(x.withColumn("_tr", true_range()), "_tr", n, out).drop("_tr"))


def atr_exponential(bars: DataFrame, n: int, out: str = "atr") -> DataFrame:
    """The exponential flavour, from the first true range."""
    return in_blocks(bars, ema_reach(n) + 1, lambda x: ema(x.withColumn("_tr", true_range()), "_tr", n, out, seeded_by_mean=False).drop("_tr"))


def rsi(bars: DataFrame, n: int, out: str = "rsi", flavour: str = "strategy") -> DataFrame:
    """Wilder's RSI. Where there is no loss: 50 (strategy), 100 (ml), or 100 with a gain and 50 without (features)."""
    flat = {"strategy": F.lit(50.0), "ml": F.lit(100.0), "features": F.when(F.col("_ag") > 0, 100.0).otherwise(50.0)}[flavour]
    value = F.when(F.col("_al").isNull(), 50.0).when(F.col("_al") == 0, flat).otherwise(100 - 100 / (1 + F.try_divide("_ag", "_al")))

    def with_rsi(x: DataFrame) -> DataFrame:
        change = F.col("close") - F.lag("close").over(by_bar())
        moved = x.withColumn("_gain", F.greatest(change, F.lit(0.0))).withColumn("_loss", F.greatest(-change, F.lit(0.0)))
        both = wilder(wilder(moved, "_gain", n, "_ag", first=1), "_loss", n, "_al", first=1)
        return both.withColumn(out, value).drop("_gain", "_loss", "_ag", "_al")

    return in_blocks(bars, wilder_reach(n) + 1, with_rsi)


def rsi_adjusted(bars: DataFrame, n: int, out: str = "rsi") -> DataFrame:
    """RSI of adjusted exponential averages with centre of mass n - 1: weighted means of all changes, from the n-th bar on."""
    a = 1 - 1 / n

    def with_rsi(x: DataFrame) -> DataFrame:
        change = F.coalesce(F.col("close") - F.lag("close").over(by_bar()), F.lit(0.0))
        x = x.withColumn("_gain", F.greatest(change, F.lit(0.0))).withColumn("_loss", F.greatest(-change, F.lit(0.0)))
        for c in ("_gain", "_loss"):
            x = recursion(x, F.col(c), a, 0, F.col(c), f"{c}_sum")
        # the weights of both means are the same, so their sums have the ratio of the means
        value = F.when(F.col("_loss_sum") > 0, 100 - 100 / (1 + F.try_divide("_gain_sum", "_loss_sum"))).when(F.col("_gain_sum") > 0, 100.0)
        return x.withColumn(out, F.when(F.col("bar") >= n - 1, value)).drop("_gain", "_loss", "_gain_sum", "_loss_sum")

    return in_blocks(bars, wilder_reach(n) + 1, with_rsi)


def adx(bars: DataFrame, n: int) -> DataFrame:
    """Adds plus_di, minus_di and adx: Wilder sums from bars 1..n, ADX from the mean of DX over bars n+1..2n."""

    def with_adx(x: DataFrame) -> DataFrame:
        plus, minus = directional_moves()
        x = x.withColumn("_tr", true_range()).withColumn("_plus", plus).withColumn("_minus", minus)
        for c in ("_tr", "_plus", "_minus"):
            x = recursion(x, F.col(c), 1 - 1 / n, n, F.sum(c).over(frame(n)), f"{c}_sum")
        di = lambda c: F.when(F.col("_tr_sum") > 0, F.try_divide(F.col(c) * 100, F.col("_tr_sum"))).otherwise(0.0)
        x = x.withColumn("plus_di", di("_plus_sum")).withColumn("minus_di", di("_minus_sum"))
        total = F.col("plus_di") + F.col("minus_di")
        x = x.withColumn("_dx", F.when(total > 0, F.try_divide(F.abs(F.col("plus_di") - F.col("minus_di")) * 100, total)).otherwise(0.0))
        out = recursion(x, F.col("_dx") / n, 1 - 1 / n, 2 * n, F.avg("_dx").over(frame(n)), "adx")
        return out.drop("_tr", "_plus", "_minus", "_tr_sum", "_plus_sum", "_minus_sum", "_dx")

    return in_blocks(bars, 2 * wilder_reach(n) + 1, with_adx)


def slope_angle(change: Column, bars_between: Column) -> Column:
    return F.abs(F.degrees(F.atan(change / bars_between * 10000)))


def pin_bar() -> tuple[Column, Column]:
    """Upper and lower wick over body; without a body 10 if there is a wick, else 0."""
    body = F.abs(F.col("close") - F.col("open"))
    upper, lower = F.col("high") - F.greatest("open", "close"), F.least("open", "close") - F.col("low")
    ratio = lambda w: F.when(body > 0, F.try_divide(w, body)).when(w > 0, 10.0).otherwise(0.0)
    return ratio(upper), ratio(lower)


def sessions() -> dict[str, Column]:
    h = F.hour("ts")
    return {"london": (h >= 8) & (h < 16), "ny": (h >= 13) & (h < 21), "asian": h < 8, "overlap": (h >= 13) & (h < 16)}


def lagged(column: str, n: int) -> Column:
    return F.lag(column, n).over(by_bar())



def slope_per_bar(column: str, n: int, pip: float) -> Column:
    """Pips that a column moved a bar over the last n bars."""
    return (F.col(column) - lagged(column, n)) / n / pip


def clipped(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def bar_features(bars: DataFrame) -> DataFrame:
    """Adds eight features of the market at each bar, within fixed bounds; they mean something from bar 200 on."""

    def with_features(x: DataFrame) -> DataFrame:
        x = atr(rsi(x, 14), 14)
        size, least = F.col("high") - F.col("low"), F.greatest(F.col("atr"), F.lit(1e-10))
        top, bottom, span = F.max("high").over(frame(20)), F.min("low").over(frame(20)), F.avg(size).over(frame(20))
        trend = F.avg("close").over(frame(50)) - F.avg("close").over(frame(200))
        return (
            x.withColumn("rsi_momentum", clipped((F.col("rsi") - lagged("rsi", 5)) / 20, -1.0, 1.0))
            .withColumn("atr_ratio", clipped(F.col("atr") / F.avg("atr").over(frame(50)) - 1, -2.0, 2.0))
            .withColumn("range_position", F.when(top > bottom, F.try_divide(F.col("close") - bottom, top - bottom)).otherwise(0.5))
            .withColumn("trend_alignment", F.signum(trend) * F.least(F.lit(1.0), F.abs(trend) / least))
            .withColumn("momentum_extreme", (F.col("rsi") - 50) / 50)
            .withColumn("bar_rejection", clipped(1 - F.abs(F.col("close") - F.col("open")) / (size + 1e-10), 0.0, 1.0))
            .withColumn("close_momentum", clipped((F.col("close") - lagged("close", 3)) / least, -3.0, 3.0))
            .withColumn("range_contraction", F.when(span > 0, clipped(F.try_divide(size, span), 0.3, 3.0)).otherwise(1.0))
        )

    return in_blocks(bars, wilder_reach(14) + 201, with_features)


def signal_features(bars: DataFrame) -> DataFrame:
    """Adds what a signal at a bar is judged by: volatility, trends, momentum, the candle and the recent range, in average ranges."""

    def with_features(x: DataFrame) -> DataFrame:
        x = ema(ema(atr(rsi(x, 14), 14), "close", 50, "_ema50", False), "close", 200, "_ema200", False)
        by_atr = lambda v: F.when(F.col("atr") > 0, F.try_divide(v, F.col("atr"))).otherwise(0.0)
        size = F.col("high") - F.col("low")
        return (
            x.withColumn("atr_norm", F.when(F.col("close") > 0, F.try_divide("atr", "close")).otherwise(0.0))
            .withColumn("vol_regime", F.coalesce(F.try_divide(F.col("atr"), F.avg("atr").over(frame(50))), F.lit(1.0)))
            .withColumn("trend_short", by_atr(F.col("close") - lagged("close", 5)))
            .withColumn("trend_long", by_atr(F.col("close") - lagged("close", 20)))
            .withColumn("rsi_3", F.col("rsi") - lagged("rsi", 3))
            .withColumn("rsi_10", F.col("rsi") - lagged("rsi", 10))
            .withColumn("body", F.when(size > 0, F.try_divide(F.abs(F.col("close") - F.col("open")), size)).otherwise(0.0))
            .withColumn("from_top", by_atr(F.col("close") - F.max("high").over(frame(20))))
            .withColumn("from_bottom", by_atr(F.col("close") - F.min("low").over(frame(20))))
            .withColumn("atr_change", F.when(lagged("atr", 5) > 0, F.try_divide(F.col("atr") - lagged("atr", 5), lagged("atr", 5))).otherwise(0.0))
            .withColumn("from_ema50", F.when(F.col("bar") >= 50, by_atr(F.col("close") - F.col("_ema50"))).otherwise(0.0))
            .withColumn("from_ema200", F.when(F.col("bar") >= 200, by_atr(F.col("close") - F.col("_ema200"))).otherwise(0.0))
            .withColumn("range_by_atr", by_atr(size))
            .withColumn("upper_shadow", F.when(size > 0, F.try_divide(F.col("high") - F.greatest("open", "close"), size)).otherwise(0.0))
            .drop("_ema50", "_ema200")
        )

    return in_blocks(bars, max(wilder_reach(14), ema_reach(200)) + 51, with_features)
