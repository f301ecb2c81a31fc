"""Signal filters as predicates, and stop, target and management columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import percentiles

#: Quote currency to US dollars. Fixed values.
QUOTE_RATES = {"JPY": 0.0067, "GBP": 1.27, "EUR": 1.08, "AUD": 0.65, "NZD": 0.60, "CAD": 0.74, "CHF": 1.12}


def pip_size(pair: Column) -> Column:
    return F.when(pair.contains("JPY"), 0.01).otherwise(0.0001)


def quote_rate(pair: Column) -> Column:
    quote = F.right(F.regexp_replace(pair, "[_/]", ""), F.lit(3))
    out = F.lit(1.0)
    for currency, rate in QUOTE_RATES.items():
        out = F.when(quote == currency, rate).otherwise(out)
    return out


def close_to(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def not_against(direction: Column, long_fails: Column, short_fails: Column) -> Column:
    return ~(((direction == 1) & long_fails) | ((direction == -1) & short_fails))


def with_trend(direction: Column, price: Column, *averages: Column) -> Column:
    """Price on the side of the trade of every average; averages that aren't there yet decide nothing."""
    out = F.lit(True)
    for m in averages:
        m = F.coalesce(m, F.lit(0.0))
        out = out & ((m <= 0) | F.when(direction == 1, price > m).otherwise(price < m))
    return out


def in_session(ts: Column, start: int, end: int, monday: bool = True, friday: bool = True, friday_until: int = 24) -> Column:
    """Hours [start, end), over midnight if start > end; no Sunday; Monday and Friday as asked, Friday only before an hour."""
    hour, day = F.hour(ts), F.weekday(ts)
    hours = (hour >= start) & (hour < end) if start <= end else (hour >= start) | (hour < end)
    days = (day != 6) & (F.lit(monday) | (day != 0)) & (F.lit(friday) | (day != 4)) & ((day != 4) | (hour < friday_until))
    return hours & days


def at_most_percentile(signals: DataFrame, column: str, p: float, keys: list[str]) -> DataFrame:
    """Signals whose column is at most the p-th percentile of their own combination of keys."""
    cut = percentiles(signals, keys, F.col(f"`{column}`"), {"_cut": p / 100.0})
    return signals.join(cut, keys).filter(F.col(column) <= F.col("_cut")).drop("_cut")


def holdout(months: Column, years: Column) -> Column:
    """Share of bars to train on: 1 - months / (12 * years), kept within 0.5 and 0.9."""
    return F.greatest(F.lit(0.5), F.least(F.lit(0.9), 1 - months / (12.0 * years)))


def initial_in_hours(initial: Column, ts: Column, first: int, last: int) -> Column:
    """Hours first to last, both included, asked of initial entries only."""
    return ~initial | F.hour(ts).between(first, last)


def pulled_back(direction: Column, before: Column, now: Column, low: float, high: float) -> Column:
    """At least one of two RSI values in the extreme zone of the side of the trade."""
    return not_against(direction, (before >= low) & (now >= low), (before <= high) & (now <= high))


def in_zone(direction: Column, k: Column, low: float, high: float) -> Column:
    """No long above the low zone, no short below the high one; zones reach 20 further than their limits."""
    return not_against(direction, k > low + 20, k < high - 20)


def beyond_buffer(direction: Column, price: Column, top: Column, bottom: Column, share: float) -> Column:
    """Price beyond the edge of a range by a share of its size."""
    room = (top - bottom) * share
    return not_against(direction, price < top + room, price > bottom - room)


def steep(direction: Column, slope: Column, least: float) -> Column:
    return not_against(direction, slope < least, slope > -least)


def finite_or_zero(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def natural_log(x: Column) -> Column:
    """Logarithm as floating-point arithmetic has it: of 0 minus infinity, below 0 NaN, null of null alone."""
    return F.when(x > 0, F.ln(x)).when(x == 0, float("-inf")).when(x.isNotNull(), float("nan"))


def rounded(x: Column, digits: int) -> Column:
    """``x`` to a number of digits after the point, as C and SQL engines on it round: the product by the power of ten, not the written digits, decides; halves go away from zero."""
    t = x.cast("double") * 10.0**digits
    whole = F.floor(F.abs(t)).cast("double")
    near = F.signum(t) * (whole + (F.abs(t) - whole >= 0.5).cast("int"))
    return F.when(F.abs(t) == float("inf"), x).otherwise(F.when(F.abs(t) >= 2.0**52, t).otherwise(near) / 10.0**digits)


def floored(x: Column, digits: int) -> Column:
    """``x`` cut down to a number of digits after the point, as text as C prints it: minus zero keeps its sign, null is null."""
    t = x.cast("double") * 10**digits
    whole = F.when((t == 0) | (F.abs(t) >= 2.0**52), t).otherwise(F.floor(t).cast("double")) / 10**digits
    odd = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.when(x.isNotNull(), F.coalesce(odd, F.format_string(f"%.{digits}f", whole)))


def guarded(a: Column, b: Column, otherwise: float) -> Column:
    return F.when(b != 0, F.try_divide(a, b)).otherwise(otherwise)


def merged(base: Column, over: Column) -> Column:
    """Map with the entries of both; those of ``over`` win."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over)


def iso_time(text: Column) -> Column:
    """UTC time of an ISO text with a Z, fractions of any length cut off."""
    return F.to_timestamp(F.replace(F.substring_index(F.rtrim(F.translate(text, "Z", " ")), ".", 1), F.lit("T"), F.lit(" ")))


def offset_time(text: Column) -> Column:
    """UTC time of 'date time offset', the offset in hours."""
    parts = F.split(text, " ")
    return F.to_timestamp(F.concat_ws(" ", parts[0], parts[1])) - F.make_interval(hours=parts[2].cast("int"))


def atr_gate(atr_pips: Column, least: Column) -> Column:
    return (least == 0) | (atr_pips >= least)


def atr_stops(atr_pips: Column, multiple: Column, rr: Column, least: float = 10.0) -> tuple[Column, Column]:
    """Stop and target in pips: at least ``least``, and no target nearer than the stop."""
    sl = F.greatest(atr_pips * multiple, F.lit(least))
    return sl, F.greatest(sl * rr, sl)


def mode_stops(sl_mode: Column, tp_mode: Column, fixed: Column, atr_pips: Column, sl_mult: Column, rr: Column, tp_mult: Column, tp_fixed: Column) -> tuple[Column, Column]:
    sl = F.greatest(F.when(sl_mode == "fixed", fixed).otherwise(atr_pips * sl_mult), F.lit(10.0))
    tp = F.when(tp_mode == "rr", sl * rr).when(tp_mode == "atr", atr_pips * tp_mult).otherwise(tp_fixed)
    return sl, F.greatest(tp, sl)


def range_stop(direction: Column, price: Column, high: Column, low: Column, pip: Column, mode: Column, atr_pips: Column, multiple: Column) -> Column:
    """Distance in pips to the opposite edge of a range, or a multiple of ATR."""
    edge = F.when(direction == 1, (price - low) / pip).otherwise((high - price) / pip)
    return F.when(mode == "range", edge).otherwise(atr_pips * multiple)


def grid_distances(sl_mode: Column, tp_mode: Column, price: Column, atr: Column, fast: Column, mult: float, fixed: float, rr: float) -> tuple[Column, Column]:
    """Distances of stop and target of a grid entry; a target at the fast average lies at least half a stop away."""
    sl = F.when(sl_mode == "atr", atr * mult).otherwise(fixed)
    return sl, F.when(tp_mode == "ma", F.greatest(F.abs(fast - price), sl * 0.5)).otherwise(sl * rr)


def atr_scale(atr: Column, mean: Column) -> Column:
    """Average range over its mean, within 0.5 and 1.5; 1 without a mean."""
    return F.least(F.lit(1.5), F.greatest(F.lit(0.5), guarded(atr, mean, 1.0)))


def swing_stop(price: Column, swing: Column, pip: Column, buffer: float, scale: Column) -> tuple[Column, Column]:
    """Pips to a swing and a buffer: plain, and with the buffer scaled and at least 10 pips in all."""
    far = F.abs(price - swing) / pip
    return far + buffer, F.greatest(F.lit(10.0), far + buffer * scale)


def prices(direction: Column, price: Column, sl_pips: Column, tp_pips: Column, pip: Column) -> tuple[Column, Column]:
    return price - direction * sl_pips * pip, price + direction * tp_pips * pip


def slipped(direction: Column, price: Column, pips: float, pip: Column) -> Column:
    """Entry price moved against the trade."""
    return price + direction * pips * pip


def management_defaults(signals: DataFrame) -> DataFrame:
    """Adds the management columns that are missing, at the values that switch each off."""
    values = {"trail_mode": 0, "trail_start": 0.0, "trail_step": 0.0, "chandelier_mult": 3.0, "be_trigger": 0.0, "be_offset": 0.0, "partial_pct": 0.0, "partial_target": 0.0, "max_bars": 0, "stale_bars": 0, "atr_pips": 35.0, "quality_mult": 1.0}
    for name, value in values.items():
        if name not in signals.columns:
            signals = signals.withColumn(name, F.lit(value))
    return signals


def management(signals: DataFrame, tp_pips: Column, trailing: bool = False, be_mult: float = 0.5, be_offset: float = 0.0) -> DataFrame:
    """Management columns: break-even at a multiple of atr_pips, a partial close half way to the target."""
    values = {"use_trailing": F.lit(trailing), "trail_start": F.lit(20.0), "trail_step": F.lit(10.0), "be_trigger": F.col("atr_pips") * be_mult, "be_offset": F.lit(be_offset), "partial_pct": F.lit(0.3), "partial_target": tp_pips * 0.5, "max_bars": F.lit(0)}
    return signals.withColumns(values)


def management_at_breakeven(signals: DataFrame, be_mult: float = 0.5) -> DataFrame:
    """The same, with the partial close where the stop goes to break-even."""
    x = management(signals, F.lit(0.0), be_mult=be_mult, be_offset=2.0)
    return x.withColumn("partial_target", F.col("be_trigger"))


def management_by_stop(signals: DataFrame, sl_pips: Column, mult: float, stale_bars: int, chandelier: float = 3.0) -> DataFrame:
    """The same, with a chandelier trail, an exit of stale trades, break-even at one atr_pips and a partial close at a multiple of the stop."""
    x = management(signals, F.lit(0.0), trailing=True, be_mult=1.0, be_offset=5.0)
    return x.withColumns({"trail_mode": F.lit(1), "chandelier_mult": F.lit(chandelier), "stale_bars": F.lit(stale_bars), "partial_target": sl_pips * mult})


def valid_trial(trade_count: Column, quality: Column, sharpe: Column, least_trades: int, least_sharpe: float) -> Column:
    return (trade_count >= least_trades) & (quality > 0) & (sharpe >= least_sharpe)


def trial_value(n: Column, quality: Column, sharpe: Column, max_dd: Column, r2: Column, least: int = 20) -> Column:
    """What a search maximises: quality, or a penalty below any quality by the first gate that fails."""
    return F.when(n < least, -100.0 + n).when(quality <= 0, -300.0).when(sharpe < 0, -200.0).when(max_dd > 50, -150.0).when(r2 < 0.3, -125.0).otherwise(quality)


def possible(trials: DataFrame) -> DataFrame:
    """Trials without contradictions: trailing step at most its start, break-even offset at most its trigger."""
    for a, b in (("trail_step", "trail_start"), ("be_offset", "be_trigger")):
        if a in trials.columns and b in trials.columns:
            trials = trials.filter(F.col(a) <= F.col(b))
    return trials
