"""Queries over ticks and candles: building, checking, indicators, signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import filters as P
from ..operators import indicators as I
from ..operators import signals as G
from ..operators.selection import percentiles
from ..session import workdir
from ..sources import cache as K
from ..sources import tables as S
from .registry import query

STAMP = "yyyy-MM-dd HH:mm:ss"


def stamp(column: str = "ts"):
    return F.date_format(column, STAMP).alias(column)


def r6(column, name: str):
    return P.rounded(F.col(column) if isinstance(column, str) else column, 6).alias(name)


_T = "strftime(ts, '%Y-%m-%d %H:%M:%S') ts"
_B = f"with {S.BARS_SQL}"


def _candles(unit: str, trunc: str) -> str:
    return f"with {S.TICKS_SQL} select sym, strftime({trunc}, '%Y-%m-%d %H:%M:%S') ts, first(price order by ts, seq) open, max(price) high, min(price) low, last(price order by ts, seq) as close, count(*) volume from ticks group by 1, 2"


for _name, _width, _trunc in (
    ("m15", "15 minutes", "time_bucket(interval 15 minute, ts)"), ("m30", "30 minutes", "time_bucket(interval 30 minute, ts)"), ("h1", "1 hour", "date_trunc('hour', ts)"),
    ("h4", "4 hours", "time_bucket(interval 4 hour, ts)"), ("d", "1 day", "date_trunc('day', ts)"),
):
    query(f"a01_candles_{_name}", _candles(_name, _trunc))(lambda spark, d, w=_width: B.candles(S.ticks(spark, d), w).select("sym", stamp(), "open", "high", "low", "close", "volume"))


@query("a01_candles_weekly", f"{_B} select sym, strftime(cast(ts as date) + (7 - isodow(ts))::int, '%Y-%m-%d') as week, first(open order by ts) open, max(high) high, min(low) low, last(close order by ts) as close, sum(volume)::bigint volume from bars group by 1, 2")
def weekly(spark, d):
    return B.weekly(S.bars_h1(spark, d)).withColumn("week", F.date_format("week", "yyyy-MM-dd"))


@query("s11_rebuild_h4_from_h1", f"{_B} select sym, strftime(time_bucket(interval 4 hour, ts), '%Y-%m-%d %H:%M:%S') ts, first(open order by ts) open, max(high) high, min(low) low, last(close order by ts) as close, sum(volume)::bigint volume from bars group by 1, 2")
def rebuilt(spark, d):
    return B.coarser(S.bars_h1(spark, d), "4 hours").select("sym", stamp(), "open", "high", "low", "close", "volume")


@query("s01_bars_scan", f"{_B} select sym, {_T}, bar, open, high, low, close, volume from bars")
def bars_scan(spark, d):
    return S.bars_h1(spark, d).select("sym", stamp(), "bar", "open", "high", "low", "close", "volume")


@query("s09_cache_metadata", f"with {S.TICKS_SQL} select sym, count(*) n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') last_ts, round((epoch(max(ts)) - epoch(min(ts))) / 86400, 3) as days from ticks group by 1")
def metadata(spark, d):
    t = S.ticks(spark, d).groupBy("sym").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return t.select("sym", "n", F.date_format("a", STAMP).alias("first_ts"), F.date_format("b", STAMP).alias("last_ts"), F.round((F.col("b").cast("double") - F.col("a").cast("double")) / 86400, 3).alias("days"))


@query("s10_inventory", "with x as (select event_type sym, 'tick' tf, count(*) n from events group by 1 union all select o_orderpriority, 'day', count(distinct date_trunc('day', o_orderdate)) from orders group by 1) select * from x")
def inventory(spark, d):
    ticks = S.ticks(spark, d).groupBy("sym").agg(F.count("*").alias("n")).select("sym", F.lit("tick").alias("tf"), "n")
    days = S.bars_daily(spark, d).groupBy("sym").agg(F.count("*").alias("n")).select("sym", F.lit("day").alias("tf"), "n")
    return ticks.unionByName(days)


@query("s07_incremental_refresh", f"{_B}, cut as (select max(ts) - interval 7 day c from bars), old as (select sym, ts, close, 1 load from bars, cut where ts < c + interval 1 day), new as (select sym, ts, close + 1 as close, 2 load from bars, cut where ts >= c), u as (select * from old union all select * from new) select sym, strftime(ts, '%Y-%m-%d %H:%M:%S') ts, round(close, 6) as close, load from (select *, row_number() over (partition by sym, ts order by load desc) k from u) where k = 1")
def refresh(spark, d):
    """A cache by instrument and week; the last days come again, a little changed, and only their weeks are written anew."""
    bars = S.bars_h1(spark, d)
    last = bars.agg((F.max("ts") - F.expr("interval 7 days")).alias("c"))
    x = bars.join(F.broadcast(last)).withColumn("week", F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd"))  # one row
    columns = ["sym", "week", "ts", "close", "load"]
    old = x.filter(F.col("ts") < F.col("c") + F.expr("interval 1 day")).withColumn("load", F.lit(1)).select(*columns)
    new = x.filter(F.col("ts") >= F.col("c")).withColumn("load", F.lit(2)).withColumn("close", F.col("close") + 1).select(*columns)
    folder = workdir(spark)
    K.write(old, folder, ["sym", "week"])
    K.refresh(spark, folder, new, ["sym", "ts"], "load", ["sym", "week"])
    return spark.read.schema(new.schema).parquet(folder).select("sym", stamp(), r6("close", "close"), "load")


@query("s08_source_choice", f"""{_B}, h as (select sym, cast(ts as date) dt from bars), z as (select min(dt) + ((max(dt) - min(dt)) // 2)::int mid from h),
f as (select sym, max(dt) - min(dt) + 1 n from h, z where sym not in ('click', 'view') or dt >= mid group by 1), g as (select sym, max(dt) - min(dt) + 1 n from h group by 1)
select g.sym, coalesce(f.n, 0)::int fine_days, g.n::int direct_days, case when f.n >= 0.8::double * greatest(f.n, g.n) then 'derived' else 'direct' end source from g left join f on f.sym = g.sym""")
def source_choice(spark, d):
    """A fine source that lacks the first half for some instruments, and a direct one; judged by footers."""
    folder, bars = workdir(spark), S.bars_h1(spark, d).withColumn("day", F.to_date("ts")).select("sym", "day", "close")
    ends = bars.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    late = bars.join(F.broadcast(ends)).filter(~F.col("sym").isin("click", "view") | (F.col("day") >= F.date_add("a", F.floor(F.datediff("b", "a") / 2).cast("int")))).select(*bars.columns)  # one row
    K.write(late, f"{folder}/fine", ["sym"])
    K.write(bars, f"{folder}/direct", ["sym"])
    x = K.chosen(K.spans(spark, f"{folder}/fine", "sym", "day"), K.spans(spark, f"{folder}/direct", "sym", "day"), "sym")
    return x.select("sym", "fine_days", "direct_days", "source")


@query("p02_time_range", f"{_B} select sym, {_T}, close from bars where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-12'")
def time_range(spark, d):
    return B.between(S.bars_h1(spark, d), "2024-01-05 00:00:00", "2024-01-12 00:00:00").select("sym", stamp(), "close")


@query("p03_trailing_period", f"{_B} select b.sym, strftime(b.ts, '%Y-%m-%d %H:%M:%S') ts, b.close from bars b join (select sym, max(ts) m from bars group by 1) l on b.sym = l.sym where b.ts >= m - interval 5 day")
def trailing(spark, d):
    return B.trailing(S.bars_h1(spark, d), "5 days").select("sym", stamp(), "close")


@query("p04_padded_range", f"{_B} select sym, {_T}, close from bars where ts >= timestamp '2024-01-20' - interval 10 day and ts < timestamp '2024-01-21' + interval 1 day")
def padded(spark, d):
    at = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return B.between(S.bars_h1(spark, d), at - F.expr("interval 10 days"), at + F.expr("interval 2 days")).select("sym", stamp(), "close")


@query("p05_back_forward_split", f"{_B}, n as (select sym, count(*) n from bars group by 1) select bars.sym, case when bar < floor(n * 0.7::double) then 'back' else 'forward' end part, count(*) n, min(bar) first_bar, max(bar) last_bar from bars join n using (sym) group by 1, 2")
def split(spark, d):
    return B.split(S.bars_h1(spark, d), 0.7).groupBy("sym", "part").agg(F.count("*").alias("n"), F.min("bar").alias("first_bar"), F.max("bar").alias("last_bar"))


@query("u02_keep_last", "select event_type sym, user_id, event_id, value from (select *, row_number() over (partition by event_type, user_id order by event_id desc) k from events) where k = 1")
def keep_last(spark, d):
    e = S.read(spark, d, "events").select(F.col("event_type").alias("sym"), "user_id", "event_id", "value")
    return B.keep_last(e, ["sym", "user_id"], "event_id")


@query("u03_keep_first", "select event_type sym, user_id, event_id, value from (select *, row_number() over (partition by event_type, user_id order by event_id) k from events) where k = 1")
def keep_first(spark, d):
    e = S.read(spark, d, "events").select(F.col("event_type").alias("sym"), "user_id", "event_id", "value")
    return B.keep_first(e, ["sym", "user_id"], "event_id")


_GAPS = "gaps as (select * from (select sym, ts, lag(ts) over (partition by sym order by bar) p from bars) where p is not null and epoch(ts) - epoch(p) > 10800)"
_WEEKEND = "(isodow(p) = 5 and (isodow(ts) = 7 or epoch(ts) - epoch(p) > 172800))"


@query("v01_gaps", f"{_B}, {_GAPS} select sym, {_T}, round((epoch(ts) - epoch(p)) / 3600, 4) as hours, {_WEEKEND} weekend from gaps")
def gaps(spark, d):
    return B.gaps(S.bars_h1(spark, d), 60).select("sym", stamp(), F.round("hours", 4).alias("hours"), "weekend")


_ODD = "odd as (select b.sym, b.ts, b.bar, case when typical > 0 and high - low > 10 * typical then 'huge_range' when high = low then 'zero_range' when high < low then 'high_low_violation' end anomaly from bars b join (select sym, quantile_cont(high - low, 0.5) typical from bars group by 1) t on b.sym = t.sym)"


@query("p27_anomalies", f"{_B}, {_ODD} select sym, {_T}, bar, anomaly from odd where anomaly is not null")
def anomalies(spark, d):
    return B.anomalies(S.bars_h1(spark, d)).select("sym", stamp(), "bar", "anomaly")


@query("v01_quality", f"""{_B}, {_GAPS}, {_ODD},
base as (select sym, count(*) bars, count(*) filter (open is null or high is null or low is null or close is null) nulls, sum((open = 0)::int + (high = 0)::int + (low = 0)::int + (close = 0)::int)::bigint zeros from bars group by 1),
g as (select sym, count(*) filter (not {_WEEKEND}) gaps, count(*) filter ({_WEEKEND}) weekends from gaps group by 1), o as (select sym, count(*) anomalies from odd where anomaly is not null group by 1),
x as (select base.sym, bars, nulls, zeros, coalesce(gaps, 0) gaps, coalesce(weekends, 0) weekends, coalesce(anomalies, 0) anomalies from base left join g using (sym) left join o using (sym)),
y as (select *, greatest(0, 100 - 20 * ((nulls > 0)::int + (zeros > 0)::int + (bars < 100)::int) - 5 * ((gaps > 0)::int + (anomalies > 0)::int)) score from x)
select *, score >= 50 and bars >= 100 passed from y""")
def quality(spark, d):
    return B.quality(S.bars_h1(spark, d), 60)


# --- indicators -----------------------------------------------------------------------------


@query("i01_true_range", f"{_B} select sym, bar, round(greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)), 6) tr from bars window w as (partition by sym order by bar)")
def true_range(spark, d):
    return B.in_blocks(S.bars_h1(spark, d), 1, lambda x: x.select("sym", "bar", r6(I.true_range(), "tr")))


def _rows(n: int) -> str:
    return f"over (partition by sym order by bar rows between {n - 1} preceding and current row)"


@query("i05_sma", f"{_B} select sym, bar, round(case when bar >= 19 then avg(close) {_rows(20)} end, 6) sma from bars")
def sma(spark, d):
    return B.in_blocks(S.bars_h1(spark, d), 20, lambda x: x.select("sym", "bar", r6(I.sma("close", 20), "sma")))


@query("i13_bollinger", f"{_B}, x as (select sym, bar, avg(close) {_rows(20)} m, stddev_pop(close) {_rows(20)} s from bars) select sym, bar, round(m, 4) mid, round(m + 2 * s, 4) upper, round(m - 2 * s, 4) lower, round(case when m > 0 then 4 * s / m else 0 end, 4) width from x where bar >= 19")
def bollinger(spark, d):
    mid, up, low = I.bollinger("close", 20, 2.0)
    x = B.in_blocks(S.bars_h1(spark, d), 20, lambda x: x.select("sym", "bar", mid.alias("m"), up.alias("u"), low.alias("l")).filter("bar >= 19"))
    return x.select("sym", "bar", F.round("m", 4).alias("mid"), F.round("u", 4).alias("upper"), F.round("l", 4).alias("lower"), F.round(F.when(F.col("m") > 0, (F.col("u") - F.col("l")) / F.col("m")).otherwise(0.0), 4).alias("width"))


def _past(n: int) -> str:
    return f"over (partition by sym order by bar rows between {n} preceding and 1 preceding)"


@query("i15_donchian", f"{_B} select sym, bar, case when bar >= 20 then max(high) {_past(20)} end upper, case when bar >= 20 then min(low) {_past(20)} end lower from bars")
def donchian(spark, d):
    up, low = I.donchian(20)
    return B.in_blocks(S.bars_h1(spark, d), 20, lambda x: x.select("sym", "bar", up.alias("upper"), low.alias("lower")))


_STOCH = f"""s0 as (select *, case when bar < 13 then 0 when max(high) {_rows(14)} > min(low) {_rows(14)} then (close - min(low) {_rows(14)}) * 100 / (max(high) {_rows(14)} - min(low) {_rows(14)}) else 50 end raw from bars),
s1 as (select *, case when bar >= 2 then avg(raw) {_rows(3)} else 0 end k from s0), stoch as (select *, case when bar >= 2 then avg(k) {_rows(3)} else 0 end d from s1)"""


@query("i17_stochastic", f"{_B}, {_STOCH} select sym, bar, round(k, 4) k, round(d, 4) d from stoch")
def stochastic(spark, d):
    return B.in_blocks(S.bars_h1(spark, d), 20, lambda x: I.stochastic(x, 14, 3, 3).select("sym", "bar", F.round("k", 4).alias("k"), F.round("d", 4).alias("d")))


@query("i18_directional_moves", f"{_B}, x as (select sym, bar, high - lag(high) over w u, lag(low) over w - low dn from bars window w as (partition by sym order by bar)) select sym, bar, round(case when u > dn and u > 0 then u else 0 end, 6) plus_dm, round(case when dn > u and dn > 0 then dn else 0 end, 6) minus_dm from x")
def moves(spark, d):
    plus, minus = I.directional_moves()
    return B.in_blocks(S.bars_h1(spark, d), 1, lambda x: x.select("sym", "bar", r6(plus, "plus_dm"), r6(minus, "minus_dm")))


def _swing(column: str, op: str, s: int) -> str:
    return " + ".join(f"(case when lag({column}, {k}) over w {op} {column} or lead({column}, {k}) over w {op} {column} then 1 else 0 end)" for k in range(1, s + 1))


@query("i20_swings", f"{_B} select sym, bar, high_swing, low_swing from (select sym, bar, bar >= 5 and lead(bar, 5) over w is not null and {_swing('high', '>=', 5)} <= 1 high_swing, bar >= 5 and lead(bar, 5) over w is not null and {_swing('low', '<=', 5)} <= 1 low_swing from bars window w as (partition by sym order by bar)) where high_swing or low_swing")
def swings(spark, d):
    hi, lo = I.swings(5)
    return B.in_blocks(S.bars_h1(spark, d), 5, lambda x: x.select("sym", "bar", hi.alias("high_swing"), lo.alias("low_swing")).filter("high_swing or low_swing"), after=5)


@query("i21_strict_swings", f"{_B} select sym, bar from (select sym, bar, bar >= 3 and lead(bar, 3) over w is not null and {_swing('high', '>=', 3)} <= 0 s from bars window w as (partition by sym order by bar)) where s")
def strict_swings(spark, d):
    return B.in_blocks(S.bars_h1(spark, d), 3, lambda x: x.select("sym", "bar", I.swings(3, 0)[0].alias("s")).filter("s").select("sym", "bar"), after=3)


@query("i22_slope_angle", f"{_B} select sym, bar, round(abs(degrees(atan((close - lag(close, 5) over (partition by sym order by bar)) / 5 * 10000))), 4) angle from bars")
def angle(spark, d):
    return B.in_blocks(S.bars_h1(spark, d), 5, lambda x: x.select("sym", "bar", F.round(I.slope_angle(F.col("close") - I.lagged("close", 5), F.lit(5)), 4).alias("angle")))


@query("i25_pin_bar", f"{_B}, x as (select sym, bar, abs(close - open) b, high - greatest(open, close) u, least(open, close) - low l from bars) select sym, bar, round(case when b > 0 then u / b when u > 0 then 10 else 0 end, 4) upper, round(case when b > 0 then l / b when l > 0 then 10 else 0 end, 4) lower from x")
def pin(spark, d):
    up, low = I.pin_bar()
    return S.bars_h1(spark, d).select("sym", "bar", F.round(up, 4).alias("upper"), F.round(low, 4).alias("lower"))


@query("i26_sessions", f"{_B} select sym, count(*) filter (hour(ts) >= 8 and hour(ts) < 16) london, count(*) filter (hour(ts) >= 13 and hour(ts) < 21) ny, count(*) filter (hour(ts) < 8) asian, count(*) filter (hour(ts) >= 13 and hour(ts) < 16) overlap from bars group by 1")
def sessions(spark, d):
    return S.bars_h1(spark, d).groupBy("sym").agg(*[F.count_if(c).alias(n) for n, c in I.sessions().items()])


def _recursive(first: str, step: str, columns: str = "y") -> str:
    """SQL that walks each instrument's rows of x (sym, bar, ...) from its seed row."""
    return f"walk as (select sym, bar, {first} {columns} from x where seed union all select x.sym, x.bar, {step} from walk w join x on x.sym = w.sym and x.bar = w.bar + 1)"


_R = f"with recursive {S.BARS_SQL}"
_EMA = lambda n, src="bars": f"x as (select sym, bar, close c, bar = {n - 1} seed, avg(close) {_rows(n)} m from {src}), " + _recursive("m", f"x.c * (2::double / {n + 1}) + w.y * (1 - 2::double / {n + 1})")
_TR = "tr as (select *, greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) tr from bars window w as (partition by sym order by bar))"
_ATR = f"{_TR}, x as (select sym, bar, tr, bar = 13 seed, avg(tr) {_rows(14)} m from tr), " + _recursive("m", "(w.y * 13 + x.tr) / 14")


@query("i06_ema", f"{_R}, {_EMA(20)} select sym, bar, round(y, 4) ema from walk")
def ema(spark, d):
    return I.ema(S.bars_h1(spark, d), "close", 20, "ema").filter("bar >= 19").select("sym", "bar", F.round("ema", 4).alias("ema"))


@query("i07_ema_first_value", f"{_R}, x as (select sym, bar, close c, bar = 0 seed from bars), {_recursive('c', 'x.c * (2::double / 13) + w.y * (1 - 2::double / 13)')} select sym, bar, round(y, 4) ema from walk")
def ema_first(spark, d):
    return I.ema(S.bars_h1(spark, d), "close", 12, "ema", seeded_by_mean=False).select("sym", "bar", F.round("ema", 4).alias("ema"))


@query("i02_atr_wilder", f"{_R}, {_ATR} select sym, bar, round(y, 4) atr from walk")
def atr(spark, d):
    return I.atr(S.bars_h1(spark, d), 14).filter("bar >= 13").select("sym", "bar", F.round("atr", 4).alias("atr"))


@query("i03_atr_exponential", f"{_R}, {_TR}, x as (select sym, bar, tr, bar = 0 seed from tr), {_recursive('tr', 'x.tr * (2::double / 15) + w.y * (1 - 2::double / 15)')} select sym, bar, round(y, 4) atr from walk")
def atr_exp(spark, d):
    return I.atr_exponential(S.bars_h1(spark, d), 14).select("sym", "bar", F.round("atr", 4).alias("atr"))


@query("i04_atr_simple", f"{_B}, {_TR} select sym, bar, round(case when bar >= 13 then avg(tr) {_rows(13)} else 30 end, 4) atr from tr")
def atr_simple(spark, d):
    mean = F.round(F.when(F.col("bar") >= 13, F.avg("tr").over(I.frame(13))).otherwise(30.0), 4).alias("atr")
    return B.in_blocks(S.bars_h1(spark, d), 14, lambda x: x.withColumn("tr", I.true_range()).select("sym", "bar", mean))


def _rsi_sql(flat: str, digits: int = 4) -> str:
    return f"""{_R}, mv as (select sym, bar, greatest(close - lag(close) over w, 0) g, greatest(lag(close) over w - close, 0) l from bars window w as (partition by sym order by bar)),
x as (select *, bar = 14 seed, avg(g) {_rows(14)} mg, avg(l) {_rows(14)} ml from mv), walk as (select sym, bar, mg ag, ml al from x where seed union all select x.sym, x.bar, (w.ag * 13 + x.g) / 14, (w.al * 13 + x.l) / 14 from walk w join x on x.sym = w.sym and x.bar = w.bar + 1)
select b.sym, b.bar, round(case when al is null then 50 when al = 0 then {flat} else 100 - 100 / (1 + ag / al) end, {digits}) rsi from bars b left join walk w on b.sym = w.sym and b.bar = w.bar"""


for _flavour, _flat, _key in (("strategy", "50", "i08"), ("ml", "100", "i09"), ("features", "(case when ag > 0 then 100 else 50 end)", "i10")):
    query(f"{_key}_rsi_{_flavour}", _rsi_sql(_flat))(lambda spark, d, f=_flavour: I.rsi(S.bars_h1(spark, d), 14, "rsi", f).select("sym", "bar", F.round("rsi", 4).alias("rsi")))


@query("i19_adx", f"""{_R}, {_TR}, m as (select *, high - lag(high) over w u, lag(low) over w - low dn from tr window w as (partition by sym order by bar)),
x as (select sym, bar, tr, case when u > dn and u > 0 then u else 0 end p, case when dn > u and dn > 0 then dn else 0 end n, bar = 14 seed from m),
x1 as (select *, sum(tr) {_rows(14)} st, sum(p) {_rows(14)} sp, sum(n) {_rows(14)} sn from x),
walk as (select sym, bar, st, sp, sn from x1 where seed union all select x.sym, x.bar, w.st - w.st / 14 + x.tr, w.sp - w.sp / 14 + x.p, w.sn - w.sn / 14 + x.n from walk w join x on x.sym = w.sym and x.bar = w.bar + 1),
di as (select sym, bar, case when st > 0 then 100 * sp / st else 0 end pd, case when st > 0 then 100 * sn / st else 0 end nd from walk),
dx as (select *, case when pd + nd > 0 then 100 * abs(pd - nd) / (pd + nd) else 0 end dx from di), y as (select *, bar = 28 seed, avg(dx) {_rows(14)} mean from dx),
ax as (select sym, bar, mean v from y where seed union all select y.sym, y.bar, (a.v * 13 + y.dx) / 14 from ax a join y on y.sym = a.sym and y.bar = a.bar + 1)
select di.sym, di.bar, round(pd, 4) plus_di, round(nd, 4) minus_di, round(v, 4) adx from di left join ax on di.sym = ax.sym and di.bar = ax.bar""")
def adx(spark, d):
    return I.adx(S.bars_h1(spark, d), 14).filter("bar >= 14").select("sym", "bar", F.round("plus_di", 4).alias("plus_di"), F.round("minus_di", 4).alias("minus_di"), F.round("adx", 4).alias("adx"))


# --- signals --------------------------------------------------------------------------------


def _donchian_sql(n: int) -> str:
    return f"select sym, bar, case when close > upper and p <= upper then 1 when close < lower and p >= lower then -1 end direction, close price, {n} channel_period, upper - lower width from (select *, lag(close) over (partition by sym order by bar) p, case when bar >= {n} then max(high) {_past(n)} end upper, case when bar >= {n} then min(low) {_past(n)} end lower from bars)"


@query("g05_donchian_signals", f"{_B}, s as ({' union all '.join(_donchian_sql(n) for n in (10, 20, 40))}) select sym, bar, direction, price, channel_period, round(width, 6) channel_width from s where direction is not null")
def donchian_signals(spark, d):
    return G.donchian_variants(S.bars_h1(spark, d), [10, 20, 40]).select("sym", "bar", "direction", "price", "channel_period", r6("channel_width", "channel_width"))


@query("g07_bollinger_squeeze", f"""{_B}, x as (select *, avg(close) {_rows(20)} m, stddev_pop(close) {_rows(20)} s from bars), y as (select *, m + 1.5 * s u, m - 1.5 * s l from x),
z as (select *, lag(close) over w pc, lag(u) over w pu, lag(l) over w pl from y window w as (partition by sym order by bar)),
s as (select sym, bar, case when close > u then 1 when close < l then -1 end direction, case when m > 0 then (u - l) / m else 0 end width from z where bar >= 101 and pc <= pu and pc >= pl)
select s.sym, bar, direction, round(width, 4) width from s join (select sym, quantile_cont(width, 0.4) q from s where direction is not null group by 1) t on s.sym = t.sym where direction is not null and width <= q + 1e-12""")
def squeeze(spark, d):
    s = G.bollinger(S.bars_h1(spark, d), 20, 1.5)
    cut = percentiles(s, ["sym"], "bb_width", {"q": 0.4})
    return s.join(cut, "sym").filter(F.col("bb_width") <= F.col("q") + 1e-12).select("sym", "bar", "direction", F.round("bb_width", 4).alias("width"))


@query("g04_ema_cross", f"""{_R}, x as (select sym, bar, close c, avg(close) {_rows(9)} m9, avg(close) {_rows(21)} m21 from bars),
f as (select sym, bar, m9 y from x where bar = 8 union all select x.sym, x.bar, x.c * 0.2::double + w.y * 0.8::double from f w join x on x.sym = w.sym and x.bar = w.bar + 1),
s as (select sym, bar, m21 y from x where bar = 20 union all select x.sym, x.bar, x.c * (2::double / 22) + w.y * (1 - 2::double / 22) from s w join x on x.sym = w.sym and x.bar = w.bar + 1),
j as (select f.sym, f.bar, f.y fy, s.y sy, lag(f.y) over w pf, lag(s.y) over w ps from f join s on f.sym = s.sym and f.bar = s.bar window w as (partition by f.sym order by f.bar)),
c as (select *, case when pf <= ps and fy > sy then 1 when pf >= ps and fy < sy then -1 end direction from j where bar >= 22)
select sym, bar, direction, coalesce(bar - lag(bar) over (partition by sym order by bar), 500)::int since from c where direction is not null""")
def ema_cross(spark, d):
    return G.ema_cross(S.bars_h1(spark, d), 9, 21).select("sym", "bar", "direction", F.col("bars_since_last_cross").cast("int").alias("since"))


@query("g06_session_breakout", f"""{_B}, x as (select *, cast(ts as date) as "day", hour(ts) h, lag(close) over (partition by sym order by bar) p0 from bars),
wk as (select *, lag(close) over (partition by sym order by bar) p from x where isodow(ts) <= 5), box as (select sym, "day", max(high) rh, min(low) rl from wk where h < 8 group by 1, 2),
s as (select wk.sym, wk.bar, wk."day", case when close > rh and p <= rh then 1 when close < rl and p >= rl then -1 end direction, rh - rl size from wk join box on wk.sym = box.sym and wk."day" = box."day" where h >= 8 and h < 14),
r as (select *, row_number() over (partition by sym, "day", direction order by bar) n from s where direction is not null) select sym, bar, direction, round(size, 6) range_size from r where n = 1""")
def breakout(spark, d):
    return G.session_breakout(S.bars_h1(spark, d), 0, 8).select("sym", "bar", "direction", r6("range_size", "range_size"))


@query("g08_stochastic_cross", f"""{_B}, {_STOCH}, c as (select *, lag(k) over w pk, lag(d) over w pd from stoch window w as (partition by sym order by bar)),
s as (select sym, bar, case when pk <= pd and k > d then 1 when pk >= pd and k < d then -1 end direction from c where bar >= 20) select * from s where direction is not null""")
def stoch_cross(spark, d):
    return G.stochastic_adx(S.bars_h1(spark, d), 14, 3, 3, 14).select("sym", "bar", "direction")


@query("g09_grid_fills", f"""{_B}, e as (select sym, bar, direction, price from ({_donchian_sql(20)}) where direction is not null), l as (select e.*, lv, price - direction * lv * 5.0::double lim from e, (values (1), (2), (3)) v(lv))
select l.sym, l.bar, l.direction, lv as "level", (select min(b.bar) from bars b where b.sym = l.sym and b.bar > l.bar and b.bar <= l.bar + 100 and case when l.direction = 1 then b.low <= lim else b.high >= lim end) fill_bar from l""")
def grid(spark, d):
    bars = S.bars_h1(spark, d)
    entries = G.donchian(bars, 20).select("sym", "bar", "direction", "price")
    return G.grid_fills(entries, bars, [1, 2, 3], F.lit(5.0), horizon=100).select("sym", "bar", "direction", "level", "fill_bar")


@query("p13_session_filter", f"{_B}, s as ({_donchian_sql(20)}) select s.sym, s.bar, direction from s join bars b on s.sym = b.sym and s.bar = b.bar where direction is not null and isodow(ts) <> 7 and isodow(ts) <> 1 and (isodow(ts) <> 5 or hour(ts) < 18) and (hour(ts) >= 20 or hour(ts) < 6)")
def session_filter(spark, d):
    return G.donchian(S.bars_h1(spark, d), 20).filter(P.in_session(F.col("ts"), 20, 6, monday=False, friday_until=18)).select("sym", "bar", "direction")


@query("p11_trend_filter", f"{_B}, m as (select sym, bar, case when bar >= 49 then avg(close) {_rows(50)} end ma from bars), s as ({_donchian_sql(20)}) select s.sym, s.bar, direction from s join m on s.sym = m.sym and s.bar = m.bar where direction is not null and (ma is null or case when direction = 1 then price > ma else price < ma end)")
def trend_filter(spark, d):
    bars = S.bars_h1(spark, d)
    trend = B.in_blocks(bars, 50, lambda x: x.select("sym", "bar", I.sma("close", 50).alias("ma")))
    return G.donchian(bars, 20).join(trend, ["sym", "bar"]).filter(P.with_trend(F.col("direction"), F.col("price"), F.col("ma"))).select("sym", "bar", "direction")


@query("p17_percentile_filter", f"{_B}, s as (select * from ({' union all '.join(_donchian_sql(n) for n in (10, 20))}) where direction is not null) select s.sym, bar, s.channel_period, direction from s join (select sym, channel_period, quantile_cont(width, 0.3) q from s group by 1, 2) t on s.sym = t.sym and s.channel_period = t.channel_period where width <= q")
def percentile_filter(spark, d):
    s = G.donchian_variants(S.bars_h1(spark, d), [10, 20])
    return P.at_most_percentile(s, "channel_width", 30, ["sym", "channel_period"]).select("sym", "bar", "channel_period", "direction")


@query("r01_atr_stops", f"{_R}, {_ATR}, s as ({_donchian_sql(20)}) select s.sym, s.bar, direction, round(greatest(y / 0.01::double * 1.5, 10), 3) sl_pips, round(greatest(greatest(y / 0.01::double * 1.5, 10) * 2, greatest(y / 0.01::double * 1.5, 10)), 3) tp_pips from s join walk w on s.sym = w.sym and s.bar = w.bar where direction is not null")
def stops(spark, d):
    bars = S.bars_h1(spark, d)
    s = G.donchian(bars, 20).join(I.atr(bars, 14).select("sym", "bar", "atr"), ["sym", "bar"])
    sl, tp = P.atr_stops(F.col("atr") / 0.01, F.lit(1.5), F.lit(2.0))
    return s.filter("bar >= 13").select("sym", "bar", "direction", F.round(sl, 3).alias("sl_pips"), F.round(tp, 3).alias("tp_pips"))


@query("w10_momentum", f"{_B} select sym, bar, round(close - lag(close, 3) over (partition by sym order by bar), 6) change3 from bars")
def momentum(spark, d):
    return B.in_blocks(S.bars_h1(spark, d), 3, lambda x: x.select("sym", "bar", r6(F.col("close") - I.lagged("close", 3), "change3")))


@query("f08_calendar", f"{_B} select sym, {_T}, hour(ts)::int h, (isodow(ts) - 1)::int wd, strftime(ts, '%Y-%m') ym from bars")
def calendar(spark, d):
    return S.bars_h1(spark, d).select("sym", F.hour("ts").alias("h"), F.weekday("ts").alias("wd"), F.date_format("ts", "yyyy-MM").alias("ym"), stamp())


@query("f09_floor_to_bar", "select event_id, strftime(time_bucket(interval 15 minute, ts), '%Y-%m-%d %H:%M:%S') bar_start, strftime(time_bucket(interval 15 minute, ts) + interval 15 minute, '%Y-%m-%d %H:%M:%S') next_bar from events")
def floored(spark, d):
    start = F.window("ts", "15 minutes")["start"]
    return S.ticks(spark, d).select(F.col("seq").alias("event_id"), F.date_format(start, STAMP).alias("bar_start"), F.date_format(start + F.expr("interval 15 minutes"), STAMP).alias("next_bar"))
