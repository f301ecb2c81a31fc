"""Queries of the smaller pieces: filters, lookups, window frames, orders, text and number functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import filters as P
from ..operators import indicators as I
from ..operators import matching as J
from ..operators import signals as G
from ..operators.scans import place
from ..sources import tables as S
from .market import _STOCH, STAMP, _donchian_sql, _past, _rows, _swing, r6
from .registry import query
from .research import _WIN, _windows

_B, _L = f"with {S.BARS_SQL}", f"with {S.LEDGER_SQL}"
_SIG = f"s as ({_donchian_sql(20)})"
_VAR = f"v as (select * from ({' union all '.join(_donchian_sql(n) for n in (10, 20, 40))}) where direction is not null)"


def _signals(spark, d):
    return G.donchian(S.bars_h1(spark, d), 20)


def _variants(spark, d):
    return G.donchian_variants(S.bars_h1(spark, d), [10, 20, 40])


# --- filters --------------------------------------------------------------------------------


@query("p06_holdout_ratio", "select p_partkey, round(greatest(0.5::double, least(0.9::double, 1 - (p_size % 24) / (12.0::double * (1 + p_size % 4)))), 6) ratio from part")
def holdout(spark, d):
    months, years = F.col("p_size") % 24, 1 + F.col("p_size") % 4
    return S.read(spark, d, "part").select("p_partkey", F.round(P.holdout(months, years), 6).alias("ratio"))


@query("p07_variant_filter", f"{_B}, {_VAR} select sym, bar, direction from v where channel_period = 20")
def variant(spark, d):
    return _variants(spark, d).filter("channel_period = 20").select("sym", "bar", "direction")


@query("p14_initial_hours", f"{_B}, {_VAR} select v.sym, v.bar, channel_period from v join bars b on b.sym = v.sym and b.bar = v.bar where channel_period > 10 or hour(b.ts) between 8 and 16")
def initial_hours(spark, d):
    x = _variants(spark, d)
    return x.filter(P.initial_in_hours(F.col("channel_period") == 10, F.col("ts"), 8, 16)).select("sym", "bar", "channel_period")


@query("p16_slope_band", f"{_B}, a as (select sym, bar, abs(degrees(atan((close - lag(close, 5) over (partition by sym order by bar)) / 5 * 10000))) angle from bars) select sym, bar from a where angle between 89.9995::double and 89.9999::double")
def slope_band(spark, d):
    angle = I.slope_angle(F.col("close") - I.lagged("close", 5), F.lit(5))
    return B.in_blocks(S.bars_h1(spark, d), 5, lambda x: x.select("sym", "bar", angle.alias("a"))).filter(F.col("a").between(89.9995, 89.9999)).select("sym", "bar")


@query("p18_stochastic_zone", f"""{_B}, {_STOCH}, c as (select *, lag(k) over w pk, lag(d) over w pd from stoch window w as (partition by sym order by bar)),
s as (select sym, bar, k, case when pk <= pd and k > d then 1 when pk >= pd and k < d then -1 end direction from c where bar >= 20)
select sym, bar, direction from s where direction is not null and not (direction = 1 and k > 40) and not (direction = -1 and k < 60)""")
def stochastic_zone(spark, d):
    s = G.stochastic_adx(S.bars_h1(spark, d), 14, 3, 3, 14)
    return s.filter(P.in_zone(F.col("direction"), F.col("k"), 20.0, 80.0)).select("sym", "bar", "direction")


@query("p19_breakout_buffer", f"""{_B}, x as (select *, cast(ts as date) as "day", hour(ts) h from bars), wk as (select *, lag(close) over (partition by sym order by bar) p from x where isodow(ts) <= 5),
box as (select sym, "day", max(high) rh, min(low) rl from wk where h < 8 group by 1, 2),
s as (select wk.sym, wk.bar, close, rh, rl, wk."day", case when close > rh and p <= rh then 1 when close < rl and p >= rl then -1 end direction from wk join box on wk.sym = box.sym and wk."day" = box."day" where h >= 8 and h < 14),
r as (select *, row_number() over (partition by sym, "day", direction order by bar) n from s where direction is not null)
select sym, bar, direction from r where n = 1 and not (direction = 1 and close < rh + (rh - rl) * 0.1::double) and not (direction = -1 and close > rl - (rh - rl) * 0.1::double)""")
def buffer(spark, d):
    s = G.session_breakout(S.bars_h1(spark, d), 0, 8)
    return s.filter(P.beyond_buffer(F.col("direction"), F.col("price"), F.col("range_high"), F.col("range_low"), 0.1)).select("sym", "bar", "direction")


@query("p22_valid_trials", f"{_L}, t as (select instance, count(*) n, sum(pnl) q, avg(pnl) / stddev_samp(pnl) s from ledger group by 1) select instance from t where n >= 20 and q > 0 and s >= 0.05::double")
def valid(spark, d):
    t = S.ledger(spark, d).groupBy("instance").agg(F.count("*").alias("n"), F.sum("pnl").alias("q"), (F.avg("pnl") / F.stddev_samp("pnl")).alias("s"))
    return t.filter(P.valid_trial(F.col("n"), F.col("q"), F.col("s"), 20, 0.05)).select("instance")


@query("p30_finite_or_zero", "with x as (select event_id, case event_id % 4 when 0 then 'inf'::double when 1 then '-inf'::double when 2 then 'nan'::double else value end v from events) select event_id, case when isnan(v) or isinf(v) then 0 else v end v from x")
def finite(spark, d):
    v = F.when(F.col("event_id") % 4 == 0, float("inf")).when(F.col("event_id") % 4 == 1, float("-inf")).when(F.col("event_id") % 4 == 2, float("nan")).otherwise(F.col("value"))
    return S.read(spark, d, "events").select("event_id", P.finite_or_zero(v).alias("v"))


# --- joins and lookups ----------------------------------------------------------------------


@query("j03_first_touch", f"""{_B}, {_SIG}, e as (select sym, bar, direction, price from s where direction is not null), l as (select e.*, lv, price - direction * lv * 8.0::double lim from e, (values (1), (2)) v(lv))
select l.sym, l.bar, lv as "level", (select min(b.bar) from bars b where b.sym = l.sym and b.bar > l.bar and b.bar <= l.bar + 499 and case when l.direction = 1 then b.low <= lim else b.high >= lim end) fill_bar from l""")
def first_touch(spark, d):
    bars = S.bars_h1(spark, d)
    entries = G.donchian(bars, 20).select("sym", "bar", "direction", "price")
    return G.grid_fills(entries, bars, [1, 2], F.lit(8.0)).select("sym", "bar", "level", "fill_bar")


@query("j05_replay_match", f"""{_B}, {_VAR}, a as (select sym, bar, direction from v where channel_period = 40), b as (select sym, bar other, direction from v where channel_period = 10),
m as (select a.*, other, row_number() over (partition by a.sym, a.bar order by abs(other - a.bar), other) k from a left join b on a.sym = b.sym and a.direction = b.direction and abs(other - a.bar) <= 2) select sym, bar, direction, other from m where k = 1""")
def replay(spark, d):
    v = _variants(spark, d)
    a, b = v.filter("channel_period = 40").select("sym", "bar", "direction"), v.filter("channel_period = 10").select("sym", F.col("bar").alias("other"), "direction")
    return J.nearest_bar(a, b, ["sym", "direction"], 2)


_CLICKS = "select event_id, user_id, ts, event_type, last_value(case when event_type = 'click' then ts end ignore nulls) over w lts, last_value(case when event_type = 'click' then event_id end ignore nulls) over w lid from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding)"


@query("j09_preceding_link", f"with x as ({_CLICKS}) select event_id, case when epoch(ts) - epoch(lts) < 3600 then lid end entry_id from x where event_type = 'purchase'")
def preceding(spark, d):
    e = S.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return J.preceding(e, ["user_id"], ["ts", "event_id"], [F.to_date("ts")], F.col("event_type") == "click", 3600, "event_id").filter("event_type = 'purchase'").select("event_id", F.col("linked").alias("entry_id"))


@query("j11_signal_lookup", f"{_B}, {_SIG}, n as (select sym, bar, direction, row_number() over (partition by sym order by bar) - 1 idx from s where direction is not null), t as (select sym, (n - 1 - o_orderkey % n)::bigint idx, o_orderkey trade_id from orders join (select sym, count(*) n, row_number() over (order by sym) - 1 k from n group by 1) on o_orderkey % 5 = k) select t.trade_id, t.sym, t.idx, bar, direction from t left join n on n.sym = t.sym and n.idx = t.idx")
def signal_lookup(spark, d):
    """Every order is a trade that names its instrument and the index of one of its signals."""
    n = place(_signals(spark, d).select("sym", "bar", "direction"), ["sym"], ["bar"], [F.floor(F.col("bar") / B.BLOCK)], "idx").withColumn("idx", (F.col("idx") - 1).cast("long"))
    counts = n.groupBy("sym").agg(F.count("*").alias("n"))
    counts = counts.withColumn("k", F.row_number().over(Window.orderBy("sym")) - 1)  # a row an instrument
    trades = S.read(spark, d, "orders").select(F.col("o_orderkey").alias("trade_id"), (F.col("o_orderkey") % 5).cast("int").alias("k")).join(counts, "k")
    trades = trades.select("trade_id", "sym", (F.col("n") - 1 - F.col("trade_id") % F.col("n")).alias("idx"))
    return trades.join(n, ["sym", "idx"], "left").select("trade_id", "sym", "idx", "bar", "direction")


@query("j12_windows_on_bars", f"with {_WIN}, x as (select distinct o_orderpriority sym, cast(o_orderdate as date) dt from orders) select w.sym, w.\"window\", count(dt) n from w left join x on x.sym = w.sym and dt >= test_start and dt < test_end group by 1, 2")
def windows_on_bars(spark, d):
    w = _windows(spark, d)
    x = S.read(spark, d, "orders").select(F.col("o_orderpriority").alias("sym"), F.to_date("o_orderdate").alias("dt")).distinct().withColumn("month", F.trunc("dt", "month"))
    # a window meets the bars of its own months only
    months = F.explode(F.sequence(F.trunc("test_start", "month"), F.trunc("test_end", "month"), F.expr("interval 1 month")))
    n = w.withColumn("month", months).join(x, ["sym", "month"]).filter("dt >= test_start and dt < test_end").groupBy("sym", "window").agg(F.count("*").alias("n"))
    return w.join(n, ["sym", "window"], "left").select("sym", "window", F.coalesce("n", F.lit(0)).alias("n"))


@query("j22_consecutive_swings", f"{_B}, f as (select sym, bar, high, bar >= 3 and lead(bar, 3) over w is not null and {_swing('high', '>=', 3)} <= 0 s from bars window w as (partition by sym order by bar)) select sym, bar, high, lag(bar) over (partition by sym order by bar) before, round(high - lag(high) over (partition by sym order by bar), 6) change from f where s")
def consecutive(spark, d):
    s = B.in_blocks(S.bars_h1(spark, d), 3, lambda x: x.select("sym", "bar", "high", I.swings(3, 0)[0].alias("s")).filter("s"), after=3)
    w = B.by_bar()  # swings are few
    return s.select("sym", "bar", "high", F.lag("bar").over(w).alias("before"), r6(F.col("high") - F.lag("high").over(w), "change"))


# --- aggregates -----------------------------------------------------------------------------


@query("a08_gross_sums", f"{_L} select instance, round(sum(case when pnl > 0 then pnl else 0 end), 2) gross_win, round(sum(case when pnl <= 0 then -pnl else 0 end), 2) gross_loss, count(*) filter (pnl <= 0) not_won from ledger group by 1")
def gross(spark, d):
    win, loss = F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0), F.when(F.col("pnl") <= 0, -F.col("pnl")).otherwise(0.0)
    return S.ledger(spark, d).groupBy("instance").agg(F.round(F.sum(win), 2).alias("gross_win"), F.round(F.sum(loss), 2).alias("gross_loss"), F.count_if(F.col("pnl") <= 0).alias("not_won"))


@query("a25_trades_per_month", f"{_L}, x as (select pair, count(*) n, datediff('day', min(cast(exit_time as date)), max(cast(exit_time as date))) as days from ledger group by 1) select pair, n, days::int as days, round(case when days > 1 then n / (days / 30.44::double) else n end, 4) per_month from x")
def per_month(spark, d):
    x = S.ledger(spark, d).groupBy("pair").agg(F.count("*").alias("n"), F.datediff(F.max("exit_time"), F.min("exit_time")).alias("days"))
    return x.withColumn("per_month", F.round(F.when(F.col("days") > 1, F.col("n") / (F.col("days") / 30.44)).otherwise(F.col("n")), 4))


@query("a26_span_score", "with x as (select event_type sym, count(*) n, datediff('day', min(cast(ts as date)), max(cast(ts as date))) as days, count(*) filter (value > 489) odd, count(*) filter (value < 0.05) low from events group by 1) select sym, days::int as days, greatest(0, 100 - 20 * ((odd > 0)::int + (n < 100)::int) - 5 * (low > 0)::int) score from x")
def span_score(spark, d):
    x = S.ticks(spark, d).groupBy("sym").agg(F.count("*").alias("n"), F.datediff(F.max("ts"), F.min("ts")).alias("days"), F.count_if(F.col("price") > 489).alias("odd"), F.count_if(F.col("price") < 0.05).alias("low"))
    yes = lambda c: c.cast("int")
    return x.select("sym", "days", B.score(yes(F.col("odd") > 0) + yes(F.col("n") < 100), yes(F.col("low") > 0)).alias("score"))


# --- windows and orders ---------------------------------------------------------------------


@query("w01_rank_by_score", f"{_L}, t as (select pair, instance, sum(pnl) q from ledger group by 1, 2) select pair, instance, row_number() over (partition by pair order by q desc, instance) as \"rank\" from t")
def rank_by_score(spark, d):
    t = S.ledger(spark, d).groupBy("pair", "instance").agg(S.total().alias("q"))
    return t.select("pair", "instance", F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("q"), "instance")).cast("long").alias("rank"))


@query("w03_previous_close", f"{_B} select sym, bar, coalesce(lag(close) over (partition by sym order by bar), close) prev from bars")
def previous(spark, d):
    return B.in_blocks(S.bars_h1(spark, d), 1, lambda x: x.select("sym", "bar", F.coalesce(I.lagged("close", 1), "close").alias("prev")))


@query("w04_trailing_frame", f"{_B} select sym, bar, case when bar >= 9 then min(low) {_rows(10)} end low10, round(case when bar >= 9 then avg(close) {_rows(10)} end, 6) mean10 from bars")
def trailing_frame(spark, d):
    return B.in_blocks(S.bars_h1(spark, d), 10, lambda x: x.select("sym", "bar", I.full(10, F.min("low").over(I.frame(10))).alias("low10"), r6(I.sma("close", 10), "mean10")))


@query("w05_frame_before", f"{_B} select sym, bar, case when bar >= 10 then max(close) {_past(10)} end top from bars")
def frame_before(spark, d):
    top = F.when(F.col("bar") >= 10, F.max("close").over(B.by_bar().rowsBetween(-10, -1)))
    return B.in_blocks(S.bars_h1(spark, d), 10, lambda x: x.select("sym", "bar", top.alias("top")))


@query("w06_symmetric_frame", f"{_B}, f as (select sym, bar, bar >= 4 and lead(bar, 4) over w is not null and {_swing('low', '<=', 4)} <= 1 s from bars window w as (partition by sym order by bar)) select sym, bar from f where s")
def symmetric(spark, d):
    return B.in_blocks(S.bars_h1(spark, d), 4, lambda x: x.select("sym", "bar", I.swings(4)[1].alias("s")).filter("s"), after=4).select("sym", "bar")


@query("w08_expanding_mean", f"{_B} select sym, bar, round(avg(high - low) {_rows(50)}, 8) mean from bars")
def expanding_mean(spark, d):
    return B.in_blocks(S.bars_h1(spark, d), 50, lambda x: x.select("sym", "bar", F.round(F.avg(F.col("high") - F.col("low")).over(I.frame(50)), 8).alias("mean")))


@query("w16_session_box", f"{_B} select sym, strftime(ts, '%Y-%m-%d') as \"day\", max(high) filter (hour(ts) < 8) top, min(low) filter (hour(ts) < 8) bottom, count(*) filter (hour(ts) < 8) n from bars where isodow(ts) <= 5 group by 1, 2")
def session_box(spark, d):
    early = lambda c: F.when(F.hour("ts") < 8, F.col(c))
    x = S.bars_h1(spark, d).filter(F.weekday("ts") < 5)
    return x.groupBy("sym", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.max(early("high")).alias("top"), F.min(early("low")).alias("bottom"), F.count(early("high")).alias("n"))


@query("w18_place_in_group", f"{_L} select instance, trade_id, leg, row_number() over (partition by instance, exit_reason order by exit_time, trade_id, leg) place from ledger")
def place_in_group(spark, d):
    x = place(S.ledger(spark, d), ["instance", "exit_reason"], ["exit_time", "trade_id", "leg"], [F.to_date("exit_time")], "place")
    return x.select("instance", "trade_id", "leg", F.col("place").cast("long").alias("place"))


@query("o01_stable_order", f"{_B}, {_VAR} select sym, bar, channel_period, row_number() over (partition by sym, bar order by channel_period) seq from v")
def stable_order(spark, d):
    w = Window.partitionBy("sym", "bar").orderBy("channel_period")
    return _variants(spark, d).select("sym", "bar", "channel_period", F.row_number().over(w).cast("long").alias("seq"))


@query("o07_first_ten", f"{_B}, r as (select sym, bar, round(high - low, 6) size from bars) select * from r order by size desc, sym, bar limit 10")
def first_ten(spark, d):
    return S.bars_h1(spark, d).select("sym", "bar", r6(F.col("high") - F.col("low"), "size")).orderBy(F.desc("size"), "sym", "bar").limit(10)


@query("u04_swing_union", f"{_B}, f as (select sym, bar, " + " or ".join(f"(bar >= {n} and lead(bar, {n}) over w is not null and {_swing('high', '>=', n)} <= 1)" for n in (3, 5, 7)) + " s from bars window w as (partition by sym order by bar)) select sym, bar from f where s")
def swing_union(spark, d):
    any_of = I.swings(3)[0] | I.swings(5)[0] | I.swings(7)[0]
    return B.in_blocks(S.bars_h1(spark, d), 7, lambda x: x.select("sym", "bar", any_of.alias("s")).filter("s"), after=7).select("sym", "bar")


@query("u06_known_dates", "select distinct strftime(o_orderdate, '%Y-%m-%d') as \"day\" from orders where cast(o_orderdate as date) in (select cast(l_shipdate as date) from lineitem)")
def known_dates(spark, d):
    o = S.read(spark, d, "orders").select(F.to_date("o_orderdate").alias("dt")).distinct()
    ship = S.read(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("dt"))
    return o.join(ship, "dt", "left_semi").select(F.date_format("dt", "yyyy-MM-dd").alias("day"))


# --- text, time and number functions --------------------------------------------------------


@query("f02_trim_split", "select c_custkey, split_part(trim(' ' || c_name || ' '), '#', 2) number, lower(left(c_mktsegment, 4)) seg, substr(c_mktsegment, 3, 2) part from customer")
def trim_split(spark, d):
    c = S.read(spark, d, "customer")
    name = F.trim(F.concat(F.lit(" "), "c_name", F.lit(" ")))
    return c.select("c_custkey", F.split_part(name, F.lit("#"), F.lit(2)).alias("number"), F.lower(F.left("c_mktsegment", F.lit(4))).alias("seg"), F.substring("c_mktsegment", 3, 2).alias("part"))


@query("f04_formatting", "select c_custkey, concat_ws(' | ', c_mktsegment, printf('%.1f', floor(c_acctbal * 10) / 10), printf('%05d', c_custkey)) line from customer")
def formatting(spark, d):
    key = F.when(F.col("c_custkey").isNotNull(), F.format_string("%05d", "c_custkey"))
    return S.read(spark, d, "customer").select("c_custkey", F.concat_ws(" | ", "c_mktsegment", P.floored(F.col("c_acctbal"), 1), key).alias("line"))


@query("f05_ids", "select p_partkey, trim(regexp_replace(lower(p_brand || ' ' || p_type), '[^a-z0-9]+', '_', 'g'), '_') id, p_brand || ' (' || p_type || ', size ' || p_size || ')' description from part")
def ids(spark, d):
    p = S.read(spark, d, "part")
    clean = F.regexp_replace(F.lower(F.concat_ws(" ", "p_brand", "p_type")), "[^a-z0-9]+", "_")
    return p.select("p_partkey", F.btrim(clean, F.lit("_")).alias("id"), F.concat("p_brand", F.lit(" ("), "p_type", F.lit(", size "), F.col("p_size").cast("string"), F.lit(")")).alias("description"))


@query("f06_iso_times", "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') moment from events")
def iso_times(spark, d):
    raw = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".123456789Z"))
    return S.read(spark, d, "events").select("event_id", F.date_format(P.iso_time(raw), STAMP).alias("moment"))


@query("f07_offset_times", "select event_id, strftime(date_trunc('second', ts) + to_hours(12), '%Y-%m-%d %H:%M:%S') utc from events")
def offset_times(spark, d):
    raw = F.concat(F.date_format(F.col("ts").cast("timestamp"), STAMP), F.lit(" -12"))
    return S.read(spark, d, "events").select("event_id", F.date_format(P.offset_time(raw), STAMP).alias("utc"))


@query("f10_next_bar", "select event_id, strftime(time_bucket(interval 4 hour, ts) + interval 4 hour, '%Y-%m-%d %H:%M:%S') h4, strftime(date_trunc('day', ts) + interval 1 day, '%Y-%m-%d') d1 from events")
def next_bar(spark, d):
    end = F.window("ts", "4 hours")["end"]
    return S.ticks(spark, d).select(F.col("seq").alias("event_id"), F.date_format(end, STAMP).alias("h4"), F.date_format(F.date_add(F.to_date("ts"), 1), "yyyy-MM-dd").alias("d1"))


@query("f13_numbers", "select event_id, round(sqrt(value), 6) root, round(ln(value), 6) log, sign(value - 250)::int side, round(degrees(atan(value / 100)), 6) angle, least(400, greatest(100, value)) clipped from events")
def numbers(spark, d):
    v = F.col("value")
    return S.read(spark, d, "events").select("event_id", r6(F.sqrt(v), "root"), r6(P.natural_log(v), "log"), F.signum(F.nanvl(v - 250, F.lit(0.0))).cast("int").alias("side"), r6(F.degrees(F.atan(v / 100)), "angle"), F.least(F.lit(400.0), F.greatest(F.lit(100.0), v)).alias("clipped"))


@query("f14_guarded_division", f"{_L}, x as (select instance, count(*) filter (pnl > 5000) w, count(*) filter (pnl < -5000) l from ledger group by 1) select instance, round(case when l > 0 then w / l else 999 end, 6) ratio, round(case when w + l > 0 then w * 100 / (w + l) else 50 end, 6) share from x")
def guarded(spark, d):
    x = S.ledger(spark, d).groupBy("instance").agg(F.count_if(F.col("pnl") > 5000).alias("w"), F.count_if(F.col("pnl") < -5000).alias("l"))
    return x.select("instance", r6(P.guarded(F.col("w"), F.col("l"), 999.0), "ratio"), r6(P.guarded(F.col("w") * 100, F.col("w") + F.col("l"), 50.0), "share"))


@query("f16_maps", "select n_nationkey, coalesce(case when n_nationkey % 3 = 0 then n_regionkey end, -1) given, case when n_nationkey % 2 = 0 then 'b=9,k=' || n_nationkey else 'b=2,k=' || n_nationkey end items from nation")
def maps(spark, d):
    n = S.read(spark, d, "nation")
    base = F.create_map(F.lit("k"), F.col("n_nationkey").cast("string"), F.lit("b"), F.lit("2"))
    over = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("b"), F.lit("9"))).otherwise(F.create_map(F.lit("b"), F.lit("2")))
    some = F.when(F.col("n_nationkey") % 3 == 0, F.create_map(F.lit("r"), F.col("n_regionkey")))
    items = F.array_sort(F.map_entries(P.merged(base, over)))
    return n.select("n_nationkey", F.coalesce(F.try_element_at(some, F.lit("r")), F.lit(-1)).alias("given"), F.array_join(F.transform(items, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("items"))


@query("f17_nested_json", "select o_orderkey, o_orderstatus status, o_totalprice total from orders")
def nested_json(spark, d):
    o = S.read(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_totalprice").alias("total")).alias("sums")).alias("order"))).alias("doc"))
    back = F.from_json("doc", "order struct<status: string, sums: struct<total: double>>")
    return o.select("o_orderkey", back["order"]["status"].alias("status"), back["order"]["sums"]["total"].alias("total"))


@query("f20_pip_distance", "select o_orderkey, round(o_totalprice % 100 / case when o_orderkey % 2 = 0 then 0.01::double else 0.0001::double end, 3) pips from orders")
def pips(spark, d):
    pair = F.when(F.col("o_orderkey") % 2 == 0, "USD_JPY").otherwise("EUR_USD")
    return S.read(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") % 100 / P.pip_size(pair), 3).alias("pips"))
