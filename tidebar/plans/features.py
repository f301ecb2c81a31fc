"""Queries of recursive and combined indicators, stops, management columns and feature frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import exits as E
from ..operators import filters as P
from ..operators import indicators as I
from ..operators import signals as G
from ..operators.scans import scan
from ..sources import tables as S
from .market import _ATR, _R, _TR, _donchian_sql, _past, _recursive, _rows, _swing, r6
from .more import _HELD, _held
from .registry import query

_B = f"with {S.BARS_SQL}"
_SIG = f"s as ({_donchian_sql(20)})"
PIP = 0.01


def r4(column, name: str):
    return F.round(column, 4).alias(name)


def _walk(name: str, source: str, value: str, seed: int, first: str, a: str, n: str) -> str:
    """SQL of a recursion over ``source``: first at the seed's bar, then value * n + before * a."""
    return f"{name} as (select sym, bar, ({first}) y from {source} where bar = {seed} union all select x.sym, x.bar, x.{value} * {n} + w.y * {a} from {name} w join {source} x on x.sym = w.sym and x.bar = w.bar + 1)"


_MOVES = "mv as (select *, greatest(close - lag(close) over w, 0) g, greatest(lag(close) over w - close, 0) l from bars window w as (partition by sym order by bar))"


def _rsi(n: int) -> str:
    """SQL of the strategy flavour of RSI, as table rsi{n} (sym, bar, r)."""
    return (
        f"m{n} as (select *, avg(g) {_rows(n)} mg, avg(l) {_rows(n)} ml from mv), k{n} as (select sym, bar, mg ag, ml al from m{n} where bar = {n} union all "
        f"select x.sym, x.bar, (w.ag * {n - 1} + x.g) / {n}, (w.al * {n - 1} + x.l) / {n} from k{n} w join m{n} x on x.sym = w.sym and x.bar = w.bar + 1), "
        f"rsi{n} as (select b.sym, b.bar, case when al is null then 50 when al = 0 then 50 else 100 - 100 / (1 + ag / al) end r from bars b left join k{n} k on b.sym = k.sym and b.bar = k.bar)"
    )


def _ema_sql(name: str, n: int) -> str:
    return f"{name}0 as (select sym, bar, close, avg(close) {_rows(n)} m from bars), " + _walk(name, f"{name}0", "close", n - 1, "m", f"(1 - 2::double / {n + 1})", f"(2::double / {n + 1})")


_RSI3 = ", ".join(_rsi(n) for n in (7, 14, 21))
_CONSENSUS = f"{_MOVES}, {_RSI3}, cons as (select a.sym, a.bar, (a.r + b.r + c.r) / 3 r from rsi7 a join rsi14 b on a.sym = b.sym and a.bar = b.bar join rsi21 c on a.sym = c.sym and a.bar = c.bar)"


@query("i11_rsi_adjusted", f"{_R}, {_MOVES}, x as (select sym, bar, coalesce(g, 0) g, coalesce(l, 0) l from mv), {_walk('wg', 'x', 'g', 0, 'g', '(13 / 14::double)', '1')}, {_walk('wl', 'x', 'l', 0, 'l', '(13 / 14::double)', '1')} select g.sym, g.bar, round(case when g.bar < 13 then null when l.y > 0 then 100 - 100 / (1 + g.y / l.y) when g.y > 0 then 100 end, 4) rsi from wg g join wl l on g.sym = l.sym and g.bar = l.bar")
def rsi_adjusted(spark, d):
    return I.rsi_adjusted(S.bars_h1(spark, d), 14).select("sym", "bar", r4("rsi", "rsi"))


def _with_consensus(x, periods=(7, 14, 21)):
    for n in periods:
        x = I.rsi(x, n, f"rsi{n}")
    return x.withColumn("consensus", reduce(lambda a, b: a + b, [F.col(f"rsi{n}") for n in periods]) / len(periods))


@query("i12_rsi_consensus", f"{_R}, {_CONSENSUS} select sym, bar, round(r, 4) rsi from cons")
def consensus(spark, d):
    return B.in_blocks(S.bars_h1(spark, d), I.wilder_reach(21) + 1, _with_consensus).select("sym", "bar", r4("consensus", "rsi"))


_UNION = " or ".join("(bar >= {0} and lead(bar, {0}) over w is not null and {1} <= 1)".format(n, _swing("{c}", "{op}", n)) for n in (3, 5, 7))
_FLAGS = f"fl as (select b.*, r, {_UNION.format(c='high', op='>=')} hs, {_UNION.format(c='low', op='<=')} ls, lead(close, 8) over w at_price from bars b join cons on b.sym = cons.sym and b.bar = cons.bar window w as (partition by b.sym order by b.bar))".replace("bar >= ", "b.bar >= ").replace("lead(bar", "lead(b.bar")


def _side(flag: str, price: str, sign: int) -> str:
    return (
        f"select sym, bar + 8 bar, {sign} direction, at_price price, bar - pb bars_between, abs(r - pr) rsi_diff, r rsi_value, pr prev_rsi, abs(degrees(atan(({price} - pp) / (bar - pb) * 10000))) price_slope from "
        f"(select *, lag({price}) over w pp, lag(r) over w pr, lag(bar) over w pb from fl where {flag} window w as (partition by sym order by bar)) where bar - pb between 2 and 120 and {sign} * {price} > {sign} * pp and {sign} * r < {sign} * pr and at_price is not null"
    )


_DIV = f"{_CONSENSUS}, {_FLAGS}, dv as ({_side('ls', 'low', 1)} union all {_side('hs', 'high', -1)})"


@query("g01_hidden_divergence", f"{_R}, {_DIV} select sym, bar::int bar, direction, price, (bars_between)::int bars_between, round(rsi_diff, 4) rsi_diff, round(price_slope, 4) price_slope from dv")
def divergence(spark, d):
    return G.divergence(S.bars_h1(spark, d)).select("sym", "bar", "direction", "price", F.col("bars_between").cast("int").alias("bars_between"), r4("rsi_diff", "rsi_diff"), r4("price_slope", "price_slope"))


@query("p15_pullback", f"{_R}, {_DIV} select sym, bar::int bar, direction from dv where not (direction = 1 and prev_rsi >= 45 and rsi_value >= 45) and not (direction = -1 and prev_rsi <= 55 and rsi_value <= 55)")
def pullback(spark, d):
    s = G.divergence(S.bars_h1(spark, d))
    return s.filter(P.pulled_back(F.col("direction"), F.col("prev_rsi"), F.col("rsi_value"), 45.0, 55.0)).select("sym", "bar", "direction")


_DIVATR = f"{_DIV}, {_ATR.replace('x as (', 'xa as (').replace(' x ', ' xa ').replace('x.', 'xa.')}".replace("from x where seed", "from xa where seed").replace("join x on", "join xa on")
_DA = "da as (select dv.sym, dv.bar::int bar, direction, price, y / 0.01::double atr_pips from dv join walk on dv.sym = walk.sym and dv.bar = walk.bar)"


def _managed(spark, d):
    """Divergence signals with their average range in pips."""
    bars = S.bars_h1(spark, d)
    a = I.atr(bars, 14).filter("bar >= 13").select("sym", "bar", (F.col("atr") / PIP).alias("atr_pips"))
    return G.divergence(bars).join(a, ["sym", "bar"])


@query("g02_divergence_v4", f"{_R}, {_DIVATR}, {_DA} select sym, bar, direction, round(atr_pips * 2, 3) sl_pips, round(atr_pips * 3, 3) tp_pips, round(atr_pips * 0.5::double, 3) be_trigger, round(atr_pips * 0.5::double, 3) partial_target from da")
def divergence_v4(spark, d):
    x = P.management_at_breakeven(_managed(spark, d), 0.5)
    return x.select("sym", "bar", "direction", F.round(F.col("atr_pips") * 2, 3).alias("sl_pips"), F.round(F.col("atr_pips") * 3, 3).alias("tp_pips"), F.round("be_trigger", 3).alias("be_trigger"), F.round("partial_target", 3).alias("partial_target"))


@query("g03_divergence_v5", f"{_R}, {_DIVATR}, {_DA} select sym, bar, direction, 1 trail_mode, 3.0::double chandelier_mult, 12 stale_bars, round(atr_pips, 3) be_trigger, round(atr_pips * 2 * 1.5::double, 3) partial_target from da")
def divergence_v5(spark, d):
    x = P.management_by_stop(_managed(spark, d), F.col("atr_pips") * 2, 1.5, 12)
    return x.select("sym", "bar", "direction", "trail_mode", "chandelier_mult", "stale_bars", F.round("be_trigger", 3).alias("be_trigger"), F.round("partial_target", 3).alias("partial_target"))


# --- indicators -----------------------------------------------------------------------------


def _signals_with_atr(spark, d):
    bars = S.bars_h1(spark, d)
    return G.donchian(bars, 20).join(I.atr(bars, 14).filter("bar >= 13").select("sym", "bar", "atr"), ["sym", "bar"])


_SA = f"{_ATR}, {_SIG}, sa as (select s.sym, s.bar, direction, price, width, y atr from s join walk w on s.sym = w.sym and s.bar = w.bar where direction is not null)"


@query("i16_channel_in_atr", f"{_R}, {_SA} select sym, bar, direction, round(case when atr > 0 then width / atr else 0 end, 4) width_atr from sa")
def channel_in_atr(spark, d):
    return _signals_with_atr(spark, d).select("sym", "bar", "direction", r4(P.guarded(F.col("channel_width"), F.col("atr"), 0.0), "width_atr"))


@query("p21_atr_gate", f"{_R}, {_SA} select sym, bar, 'off' gate from sa union all select sym, bar, 'on' from sa where atr / 0.01::double >= 8000")
def atr_gate(spark, d):
    s = _signals_with_atr(spark, d).withColumn("least", F.explode(F.array(F.lit(0.0), F.lit(8000.0))))
    return s.filter(P.atr_gate(F.col("atr") / PIP, F.col("least"))).select("sym", "bar", F.when(F.col("least") == 0, "off").otherwise("on").alias("gate"))


@query("i23_ema_slope", f"{_R}, {_ema_sql('e', 20)} select sym, bar, round((y - lag(y, 5) over (partition by sym order by bar)) / 5 / 0.01::double, 2) slope from e")
def ema_slope(spark, d):
    x = B.in_blocks(S.bars_h1(spark, d), I.ema_reach(20) + 5, lambda x: I.ema(x, "close", 20, "ema").filter("bar >= 19").select("sym", "bar", I.slope_per_bar("ema", 5, PIP).alias("slope")))
    return x.select("sym", "bar", F.round("slope", 2).alias("slope"))


_CROSS = f"""{_ema_sql('f', 9)}, {_ema_sql('s', 21)}, {_ATR.replace('_', '_')},
j as (select f.sym, f.bar, f.y fy, s.y sy, a.y atr, lag(f.y) over w pf, lag(s.y) over w ps, lag(f.y, 3) over w f3, lag(s.y, 3) over w s3 from f join s on f.sym = s.sym and f.bar = s.bar join walk a on a.sym = f.sym and a.bar = f.bar window w as (partition by f.sym order by f.bar)),
c as (select *, case when pf <= ps and fy > sy then 1 when pf >= ps and fy < sy then -1 end direction from j where bar >= 22)"""


@query("i24_cross_features", f"{_R}, {_CROSS} select sym, bar, direction, round(abs(fy - sy) / atr, 4) separation, round((fy - f3) / atr, 4) fast_slope, round((sy - s3) / atr, 4) slow_slope, round(((fy - sy) - (pf - ps)) / atr, 4) velocity from c where direction is not null and s3 is not null")
def cross_features(spark, d):
    return G.cross_features(S.bars_h1(spark, d), 9, 21).filter("bar >= 23").select("sym", "bar", "direction", *[r4(c, c) for c in ("separation", "fast_slope", "slow_slope", "velocity")])


_FEATURES = f"""{_MOVES}, {_rsi(14)}, {_ATR},
t as (select b.*, r, y atr, avg(y) over (partition by b.sym order by b.bar rows between 49 preceding and current row) atr50, avg(close) over (partition by b.sym order by b.bar rows between 49 preceding and current row) ma50, avg(close) over (partition by b.sym order by b.bar rows between 199 preceding and current row) ma200,
 max(high) over (partition by b.sym order by b.bar rows between 19 preceding and current row) top, min(low) over (partition by b.sym order by b.bar rows between 19 preceding and current row) bottom, avg(high - low) over (partition by b.sym order by b.bar rows between 19 preceding and current row) span,
 lag(r, 5) over (partition by b.sym order by b.bar) r5, lag(close, 3) over (partition by b.sym order by b.bar) c3
 from bars b join rsi14 q on q.sym = b.sym and q.bar = b.bar left join walk a on a.sym = b.sym and a.bar = b.bar),
ft as (select sym, bar, least(1, greatest(-1, (r - r5) / 20)) rsi_momentum, least(2, greatest(-2, atr / atr50 - 1)) atr_ratio, case when top > bottom then (close - bottom) / (top - bottom) else 0.5 end range_position,
 sign(ma50 - ma200) * least(1, abs(ma50 - ma200) / greatest(atr, 1e-10)) trend_alignment, (r - 50) / 50 momentum_extreme, greatest(0, least(1, 1 - abs(close - open) / (high - low + 1e-10))) bar_rejection, least(3, greatest(-3, (close - c3) / greatest(atr, 1e-10))) close_momentum,
 case when span > 0 then least(3, greatest(0.3, (high - low) / span)) else 1 end range_contraction from t where bar >= 200)"""
_NAMES = ("rsi_momentum", "atr_ratio", "range_position", "trend_alignment", "momentum_extreme", "bar_rejection", "close_momentum", "range_contraction")


@query("i27_bar_features", f"{_R}, {_FEATURES} select sym, bar, " + ", ".join(f"round({c}, 3) + 0.0::double {c}" for c in _NAMES) + " from ft")
def bar_features(spark, d):
    return I.bar_features(S.bars_h1(spark, d)).filter("bar >= 200").select("sym", "bar", *[(F.round(c, 3) + 0.0).alias(c) for c in _NAMES])


_LONG = (-1, 1, 1, -1, 1, 1, -1, -1)
_SHORT = (1, 1, -1, 1, -1, 1, 1, -1)
_WEIGHTS = (0.2, 0.1, 0.15, 0.1, 0.15, 0.1, 0.1, 0.1)


@query("i28_exit_urgency", f"{_R}, {_FEATURES} select sym, bar, " + ", ".join(f"round(greatest(0, {' + '.join(f'({c} * {w * f}::double)' for c, w, f in zip(_NAMES, _WEIGHTS, flips))}), 3) {side}" for side, flips in (("long", _LONG), ("short", _SHORT))) + " from ft")
def exit_urgency(spark, d):
    x = I.bar_features(S.bars_h1(spark, d)).filter("bar >= 200")
    long, short = E.urgency([F.col(c) for c in _NAMES], list(_WEIGHTS))
    return x.select("sym", "bar", F.round(long, 3).alias("long"), F.round(short, 3).alias("short"))


@query("i29_buffer_scale", f"{_R}, {_ATR}, z as (select sym, bar, y, avg(y) over (partition by sym order by bar rows between 99 preceding and current row) mean from walk) select sym, bar, round(least(1.5, greatest(0.5, case when mean > 0 then y / mean else 1 end)), 4) \"scale\" from z where bar >= 112")
def buffer_scale(spark, d):
    f = lambda x: I.atr(x, 14).withColumn("scale", P.atr_scale(F.col("atr"), F.avg("atr").over(I.frame(100))))
    return B.in_blocks(S.bars_h1(spark, d), I.wilder_reach(14) + 101, f).filter("bar >= 112").select("sym", "bar", r4("scale", "scale"))


@query("p20_touch_filters", f"""{_R}, {_ema_sql('e', 20)}, x as (select b.*, e.y ema, (e.y - lag(e.y, 5) over (partition by b.sym order by b.bar)) / 5 / 0.01::double slope from bars b join e on b.sym = e.sym and b.bar = e.bar),
y as (select sym, bar, case when close > ema then 1 else -1 end direction, case when close > ema then low - ema else ema - high end / 0.01::double touch, case when abs(close - open) > 0 then (case when close > ema then least(open, close) - low else high - greatest(open, close) end) / abs(close - open) when (case when close > ema then least(open, close) - low else high - greatest(open, close) end) > 0 then 10 else 0 end ratio, slope from x)
select sym, bar, direction from y where touch <= 500 and ratio >= 0.5 and not (direction = 1 and slope < 100) and not (direction = -1 and slope > -100)""")
def touches(spark, d):
    def f(x):
        up, low = I.pin_bar()
        x = I.ema(x, "close", 20, "ema").filter("bar >= 19").withColumn("slope", I.slope_per_bar("ema", 5, PIP)).withColumn("direction", F.when(F.col("close") > F.col("ema"), 1).otherwise(-1))
        long = F.col("direction") == 1
        x = x.withColumn("touch", F.when(long, F.col("low") - F.col("ema")).otherwise(F.col("ema") - F.col("high")) / PIP).withColumn("ratio", F.when(long, low).otherwise(up))
        return x.filter((F.col("touch") <= 500) & (F.col("ratio") >= 0.5) & P.steep(F.col("direction"), F.col("slope"), 100.0)).select("sym", "bar", "direction")

    return B.in_blocks(S.bars_h1(spark, d), I.ema_reach(20) + 5, f)


# --- stops and management -------------------------------------------------------------------


@query("r03_raw_multiples", f"{_R}, {_SA} select sym, bar, round(price - direction * atr * 2, 4) sl, round(price + direction * atr * 4, 4) tp from sa")
def raw_multiples(spark, d):
    sl, tp = P.prices(F.col("direction"), F.col("price"), F.col("atr") * 2, F.col("atr") * 4, F.lit(1.0))
    return _signals_with_atr(spark, d).select("sym", "bar", r4(sl, "sl"), r4(tp, "tp"))


@query("r04_range_stops", f"""{_R}, {_ATR}, x0 as (select *, cast(ts as date) as "day", hour(ts) h from bars), wk as (select *, lag(close) over (partition by sym order by bar) p from x0 where isodow(ts) <= 5),
box as (select sym, "day", max(high) rh, min(low) rl from wk where h < 8 group by 1, 2),
s as (select wk.sym, wk.bar, close price, rh, rl, wk."day", case when close > rh and p <= rh then 1 when close < rl and p >= rl then -1 end direction from wk join box on wk.sym = box.sym and wk."day" = box."day" where h >= 8 and h < 14),
r as (select *, row_number() over (partition by sym, "day", direction order by bar) n from s where direction is not null),
t as (select r.sym, r.bar, direction, price, rh, rl, y / 0.01::double ap, case when r.bar % 2 = 0 then 'range' else 'atr' end md from r join walk w on w.sym = r.sym and w.bar = r.bar where n = 1),
u as (select *, greatest(10, case when md = 'range' then case when direction = 1 then (price - rl) / 0.01::double else (rh - price) / 0.01::double end else ap * 1.5::double end) sl from t)
select sym, bar, md, round(sl, 2) sl_pips, round(greatest(sl * 0.8::double, sl), 2) tp_pips from u""")
def range_stops(spark, d):
    bars = S.bars_h1(spark, d)
    s = G.session_breakout(bars, 0, 8).join(I.atr(bars, 14).filter("bar >= 13").select("sym", "bar", "atr"), ["sym", "bar"]).withColumn("md", F.when(F.col("bar") % 2 == 0, "range").otherwise("atr"))
    sl = F.greatest(F.lit(10.0), P.range_stop(F.col("direction"), F.col("price"), F.col("range_high"), F.col("range_low"), F.lit(PIP), F.col("md"), F.col("atr") / PIP, F.lit(1.5)))
    return s.select("sym", "bar", "md", F.round(sl, 2).alias("sl_pips"), F.round(F.greatest(sl * 0.8, sl), 2).alias("tp_pips"))


@query("r05_grid_stops", f"{_R}, {_SA}, {_ema_sql('e', 9)}, t as (select sa.*, e.y fast, case when sa.bar % 2 = 0 then atr * 3 else 40.0::double end sl from sa join e on e.sym = sa.sym and e.bar = sa.bar) select sym, bar, round(price - direction * sl, 4) sl, round(price + direction * case when bar % 3 = 0 then greatest(abs(fast - price), sl * 0.5::double) else sl * 3 end, 4) tp from t")
def grid_stops(spark, d):
    e = I.ema(S.bars_h1(spark, d), "close", 9, "fast").filter("bar >= 8").select("sym", "bar", "fast")
    s = _signals_with_atr(spark, d).join(e, ["sym", "bar"])
    sl, tp = P.grid_distances(F.when(F.col("bar") % 2 == 0, "atr").otherwise("fixed"), F.when(F.col("bar") % 3 == 0, "ma").otherwise("rr"), F.col("price"), F.col("atr"), F.col("fast"), 3.0, 40.0, 3.0)
    sl, tp = P.prices(F.col("direction"), F.col("price"), sl, tp, F.lit(1.0))
    return s.select("sym", "bar", r4(sl, "sl"), r4(tp, "tp"))


@query("r06_swing_stops", f"{_R}, {_ATR}, {_SIG}, z as (select sym, bar, y, avg(y) over (partition by sym order by bar rows between 99 preceding and current row) mean from walk), lo as (select sym, bar, case when bar >= 10 then min(low) {_past(10)} end dn, case when bar >= 10 then max(high) {_past(10)} end up from bars), t as (select s.sym, s.bar, abs(price - case when direction = 1 then dn else up end) / 0.01::double dist, least(1.5, greatest(0.5, y / mean)) sc from s join z on z.sym = s.sym and z.bar = s.bar join lo on lo.sym = s.sym and lo.bar = s.bar where direction is not null) select sym, bar, round(dist + 10, 2) plain, round(greatest(10, dist + 10 * sc), 2) scaled from t")
def swing_stops(spark, d):
    bars = S.bars_h1(spark, d)
    up, low = I.donchian(10)
    f = lambda x: I.atr(x.withColumn("up", up).withColumn("dn", low), 14).withColumn("scale", P.atr_scale(F.col("atr"), F.avg("atr").over(I.frame(100)))).select("sym", "bar", "up", "dn", "scale")
    x = G.donchian(bars, 20).join(B.in_blocks(bars, I.wilder_reach(14) + 101, f), ["sym", "bar"])
    swing = F.when(F.col("direction") == 1, F.col("dn")).otherwise(F.col("up"))
    plain, scaled = P.swing_stop(F.col("price"), swing, F.lit(PIP), 10.0, F.col("scale"))
    return x.select("sym", "bar", F.round(plain, 2).alias("plain"), F.round(scaled, 2).alias("scaled"))


@query("m01_management", f"{_R}, {_SA}, t as (select *, atr / 0.01::double ap from sa) select sym, bar, true use_trailing, 20.0::double trail_start, 10.0::double trail_step, round(ap * 0.5::double, 3) be_trigger, 2.0::double be_offset, 0.3::double partial_pct, round(ap * 1.5::double * 2 * 0.5::double, 3) partial_target, 0 max_bars from t")
def management(spark, d):
    x = _signals_with_atr(spark, d).withColumn("atr_pips", F.col("atr") / PIP)
    x = P.management(x, F.col("atr_pips") * 1.5 * 2, trailing=True, be_mult=0.5, be_offset=2.0)
    return x.select("sym", "bar", "use_trailing", "trail_start", "trail_step", F.round("be_trigger", 3).alias("be_trigger"), "be_offset", "partial_pct", F.round("partial_target", 3).alias("partial_target"), "max_bars")


@query("m02_partial_at_breakeven", f"{_R}, {_SA}, t as (select *, atr / 0.01::double ap from sa) select sym, bar, round(ap * 0.5::double, 3) be_trigger, round(ap * 0.5::double, 3) partial_target, 2.0::double be_offset from t")
def partial_at_breakeven(spark, d):
    x = P.management_at_breakeven(_signals_with_atr(spark, d).withColumn("atr_pips", F.col("atr") / PIP), 0.5)
    return x.select("sym", "bar", F.round("be_trigger", 3).alias("be_trigger"), F.round("partial_target", 3).alias("partial_target"), "be_offset")


@query("m03_chandelier", f"{_R}, {_SA}, t as (select *, atr / 0.01::double ap from sa) select sym, bar, 1 trail_mode, 3.0::double chandelier_mult, 24 stale_bars, round(ap, 3) be_trigger, 5.0::double be_offset, round(ap * 1.5::double * 1.2::double, 3) partial_target from t")
def chandelier(spark, d):
    x = _signals_with_atr(spark, d).withColumn("atr_pips", F.col("atr") / PIP)
    x = P.management_by_stop(x, F.col("atr_pips") * 1.5, 1.2, 24)
    return x.select("sym", "bar", "trail_mode", "chandelier_mult", "stale_bars", F.round("be_trigger", 3).alias("be_trigger"), "be_offset", F.round("partial_target", 3).alias("partial_target"))


@query("m04_max_hold", f"{_B}, {_SIG} select sym, bar, 48 max_bars, 0.0::double trail_start, 0.0::double be_trigger, 0.0::double partial_pct from s where direction is not null")
def max_hold(spark, d):
    x = P.management_defaults(G.donchian(S.bars_h1(spark, d), 20).withColumn("max_bars", F.lit(48)))
    return x.select("sym", "bar", "max_bars", "trail_start", "be_trigger", "partial_pct")


@query("m05_defaults", f"{_B}, {_SIG} select sym, bar, 0 trail_mode, 3.0::double chandelier_mult, 35.0::double atr_pips, 1.0::double quality_mult, 0 stale_bars from s where direction is not null")
def defaults(spark, d):
    return P.management_defaults(G.donchian(S.bars_h1(spark, d), 20)).select("sym", "bar", "trail_mode", "chandelier_mult", "atr_pips", "quality_mult", "stale_bars")


# --- feature frames -------------------------------------------------------------------------


def _ema_of(n: int) -> str:
    return f"({_R}, x as (select sym, bar, close c, bar = 0 seed from bars), {_recursive('c', f'x.c * (2::double / {n + 1}) + w.y * (1 - 2::double / {n + 1})')} select sym, bar, y from walk)"


@query("l04_signal_features", f"""{_R}, {_MOVES}, {_rsi(14)}, {_ATR}, {_SIG},
t as (select b.*, r, y atr, avg(y) over w50 atr50, lag(close, 5) over w c5, lag(close, 20) over w c20, lag(r, 3) over w r3, lag(r, 10) over w r10, lag(y, 5) over w y5, max(high) over w20 top, min(low) over w20 bottom from bars b join rsi14 q on q.sym = b.sym and q.bar = b.bar left join walk a on a.sym = b.sym and a.bar = b.bar
 window w as (partition by b.sym order by b.bar), w50 as (partition by b.sym order by b.bar rows between 49 preceding and current row), w20 as (partition by b.sym order by b.bar rows between 19 preceding and current row))
select t.sym, t.bar, s.direction, round(atr / close, 4) atr_norm, round(atr / atr50, 4) vol_regime, round((close - c5) / atr, 4) trend_short, round((close - c20) / atr, 4) trend_long, round(r, 4) rsi, round(r - r3, 4) rsi_3, round(r - r10, 4) rsi_10, hour(ts)::int "hour", (isodow(ts) - 1)::int weekday,
 round(case when high > low then abs(close - open) / (high - low) else 0 end, 4) body, round(s.direction * (close - c20) / atr, 4) aligned, round((close - top) / atr, 4) from_top, round((close - bottom) / atr, 4) from_bottom,
 round(case when y5 > 0 then (atr - y5) / y5 else 0 end, 4) atr_change, round(case when t.bar >= 50 then (close - e50.y) / atr else 0 end, 4) from_ema50, round(case when t.bar >= 200 then (close - e200.y) / atr else 0 end, 4) from_ema200, round((high - low) / atr, 4) range_by_atr,
 round(case when high > low then (high - greatest(open, close)) / (high - low) else 0 end, 4) upper_shadow, s.since from t join (select sym, bar, direction, least(500, coalesce(bar - lag(bar) over (partition by sym order by bar), 500))::int since from s where direction is not null) s on s.sym = t.sym and s.bar = t.bar
 join {_ema_of(50)} e50 on e50.sym = t.sym and e50.bar = t.bar join {_ema_of(200)} e200 on e200.sym = t.sym and e200.bar = t.bar where s.direction is not null""")
def signal_features(spark, d):
    bars = S.bars_h1(spark, d)
    s = scan(G.donchian(bars, 20).select("sym", "bar", "direction"), ["sym"], ["bar"], [f"floor(bar / {B.BLOCK})"], lasts={"signal": F.col("bar")})
    s = s.withColumn("since", F.least(F.lit(500), F.coalesce(F.col("bar") - F.col("signal_before"), F.lit(500))).cast("int"))
    x = s.join(I.signal_features(bars), ["sym", "bar"]).withColumn("aligned", F.col("direction") * F.col("trend_long"))
    names = ("atr_norm", "vol_regime", "trend_short", "trend_long", "rsi", "rsi_3", "rsi_10", "body", "aligned", "from_top", "from_bottom", "atr_change", "from_ema50", "from_ema200", "range_by_atr", "upper_shadow")
    return x.select("sym", "bar", "direction", "since", F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"), *[r4(c, c) for c in names])
