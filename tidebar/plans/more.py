"""Further queries of the inventory: projections, joins, labels, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import exits as E
from ..operators import expanding as W
from ..operators import filters as P
from ..operators import indicators as I
from ..operators import matching as J
from ..operators import metrics as M
from ..operators import signals as G
from ..operators import simulate as X
from ..operators.scans import scan
from ..sources import tables as S
from .market import _donchian_sql, _rows
from .registry import query
from .research import _EXIT, _ORD, _orders

_B, _L = f"with {S.BARS_SQL}", f"with {S.LEDGER_SQL}"


@query("p01_vectors", f"{_B} select sym, bar, close::double c, (isodow(ts) - 1)::bigint wd from bars")
def vectors(spark, d):
    return S.bars_h1(spark, d).select("sym", "bar", F.col("close").cast("double").alias("c"), F.weekday("ts").cast("long").alias("wd"))


@query("p08_close_to", "select event_id from events where abs(value - 100) <= 1e-8 + 1e-2 * 100")
def close_to(spark, d):
    return S.read(spark, d, "events").filter(P.close_to(F.col("value"), F.lit(100.0), rtol=1e-2)).select("event_id")


@query("p09_thresholds", f"{_B} select sym, bar from bars where volume between 2 and 4 and high - low between 20 and 200")
def thresholds(spark, d):
    return S.bars_h1(spark, d).filter(F.col("volume").between(2, 4) & (F.col("high") - F.col("low")).between(20, 200)).select("sym", "bar")


@query("p10_direction_rejection", f"{_L} select trade_id, leg from ledger where not ((direction = 1 and pnl < -1000) or (direction = -1 and pnl > 1000))")
def rejection(spark, d):
    return S.ledger(spark, d).filter(P.not_against(F.col("direction"), F.col("pnl") < -1000, F.col("pnl") > 1000)).select("trade_id", "leg")


@query("p12_two_averages", f"{_B}, m as (select sym, bar, case when bar >= 19 then avg(close) {_rows(20)} end a, case when bar >= 99 then avg(close) {_rows(100)} end b from bars), s as ({_donchian_sql(20)}) select s.sym, s.bar, direction from s join m on s.sym = m.sym and s.bar = m.bar where direction is not null and (a is null or (direction = 1) = (price > a)) and (b is null or (direction = 1) = (price > b))")
def two_averages(spark, d):
    bars = S.bars_h1(spark, d)
    m = B.in_blocks(bars, 100, lambda x: x.select("sym", "bar", I.sma("close", 20).alias("a"), I.sma("close", 100).alias("b")))
    return G.donchian(bars, 20).join(m, ["sym", "bar"]).filter(P.with_trend(F.col("direction"), F.col("price"), F.col("a"), F.col("b"))).select("sym", "bar", "direction")


@query("p26_zero_null_rows", "select event_type, count(*) filter (value is null) nulls, count(*) filter (value = 0) zeros, round(avg((value < 10)::int::double), 6) low_share from events group by 1")
def zero_null(spark, d):
    e = S.read(spark, d, "events")
    return e.groupBy("event_type").agg(F.count_if(F.col("value").isNull()).alias("nulls"), F.count_if(F.col("value") == 0).alias("zeros"), F.round(F.avg((F.col("value") < 10).cast("double")), 6).alias("low_share"))


@query("j01_signal_bars", f"{_B}, s as ({_donchian_sql(20)}) select s.sym, s.bar, direction, b.high, b.low from s join bars b on s.sym = b.sym and s.bar = b.bar where direction is not null")
def signal_bars(spark, d):
    bars = S.bars_h1(spark, d)
    return G.donchian(bars, 20).select("sym", "bar", "direction").join(bars.select("sym", "bar", "high", "low"), ["sym", "bar"])


@query("j07_first_within", "with a as (select event_id, user_id, ts from events where event_type = 'click'), b as (select event_id other, user_id, ts from events where event_type <> 'click'), m as (select a.event_id, min(other) other from a join b on a.user_id = b.user_id and abs(epoch_us(a.ts) - epoch_us(b.ts)) < 3600000000 group by 1) select * from m")
def first_within(spark, d):
    e = S.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    a = e.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    b = e.filter("event_type <> 'click'").select(F.col("event_id").alias("other"), "user_id", "ts")
    return J.first_within(a, b, ["user_id"], 3600, "event_id", "other").select("event_id", "other")


@query("j13_trials_on_signals", f"{_B}, s as (select * from ({' union all '.join(_donchian_sql(n) for n in (10, 20))}) where direction is not null), t(trial, p, least) as (values (1, 10, 50.0::double), (2, 10, 200.0), (3, 20, 100.0)) select trial, count(*) n from s join t on channel_period = p and width >= least group by 1")
def trials_on_signals(spark, d):
    t = spark.createDataFrame([(1, 10, 50.0), (2, 10, 200.0), (3, 20, 100.0)], "trial int, channel_period int, least double")
    s = G.donchian_variants(S.bars_h1(spark, d), [10, 20])
    return s.join(F.broadcast(t), "channel_period").filter("channel_width >= least").groupBy("trial").agg(F.count("*").alias("n"))  # a stated list


@query("j15_combinations", "select n_name, r_name, tf from nation, region, (values ('M15'), ('H1')) t(tf) where n_regionkey = r_regionkey")
def combinations(spark, d):
    n, r = S.read(spark, d, "nation"), S.read(spark, d, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("tf", F.explode(F.array(F.lit("M15"), F.lit("H1")))).select("n_name", "r_name", "tf")


@query("a21_pair_map", f"{_L}, p as (select pair, round(sum(pnl), 2) v from ledger group by 1) select count(*) pairs, round(sum(v), 2) total from p")
def pair_map(spark, d):
    p = S.ledger(spark, d).groupBy("pair").agg(F.round(F.sum("pnl"), 2).alias("v"))
    m = p.agg(F.map_from_entries(F.collect_list(F.struct("pair", "v"))).alias("m"))  # one entry a pair
    return m.select(F.size("m").cast("long").alias("pairs"), F.round(F.aggregate(F.map_values("m"), F.lit(0.0), lambda a, v: a + v), 2).alias("total"))


@query("a23_ratings", f"{_L}, t as (select instance, avg((pnl > 0)::int::double) w from ledger group by 1) select count(*) filter (w >= 0.57) green, count(*) filter (w >= 0.55 and w < 0.57) yellow, count(*) filter (w < 0.55) red from t")
def ratings(spark, d):
    t = S.ledger(spark, d).groupBy("instance").agg(F.avg((F.col("pnl") > 0).cast("double")).alias("w"))
    return t.agg(F.count_if(F.col("w") >= 0.57).alias("green"), F.count_if((F.col("w") >= 0.55) & (F.col("w") < 0.57)).alias("yellow"), F.count_if(F.col("w") < 0.55).alias("red"))


@query("w02_time_steps", f"{_B} select sym, bar, (epoch(ts) - epoch(lag(ts) over (partition by sym order by bar)))::bigint step from bars")
def steps(spark, d):
    return B.in_blocks(S.bars_h1(spark, d), 1, lambda x: x.select("sym", "bar", (F.col("ts").cast("long") - F.lag("ts").over(B.by_bar()).cast("long")).alias("step")))


@query("w07_partial_frames", f"{_B} select sym, bar, max(high) {_rows(50)} top, round(avg(close) {_rows(50)}, 8) mean from bars")
def partial_frames(spark, d):
    return B.in_blocks(S.bars_h1(spark, d), 50, lambda x: x.select("sym", "bar", F.max("high").over(I.frame(50)).alias("top"), F.round(F.avg("close").over(I.frame(50)), 8).alias("mean")))


@query("w11_since_event", f"{_B}, e as (select sym, bar, high - low > 300 hit from bars) select sym, bar, coalesce(bar - max(case when hit then bar end) over (partition by sym order by bar rows between unbounded preceding and 1 preceding), -1000)::int since from e")
def since(spark, d):
    x = scan(S.bars_h1(spark, d), ["sym"], ["bar"], [F.floor(F.col("bar") / B.BLOCK)], lasts={"event": F.when(F.col("high") - F.col("low") > 300, F.col("bar"))})
    return x.select("sym", "bar", F.coalesce(F.col("bar") - F.col("event_before"), F.lit(-1000)).cast("int").alias("since"))


@query("w15_first_of_key", f"{_L} select pair, exit_reason, instance from (select *, row_number() over (partition by pair, exit_reason order by pnl desc, trade_id, leg) k from ledger) where k = 1")
def first_of_key(spark, d):
    w = Window.partitionBy("pair", "exit_reason").orderBy(F.desc("pnl"), "trade_id", "leg")
    return S.ledger(spark, d).withColumn("k", F.row_number().over(w)).filter("k = 1").select("pair", "exit_reason", "instance")


@query("w17_continued_equity", f"{_L}, x as (select instance, trade_id, leg, exit_time, pnl, exit_time >= timestamp '1998-01-01' fwd from ledger) select instance, trade_id, leg, fwd, round(3000 + sum(pnl) over (partition by instance order by fwd, exit_time, trade_id, leg rows unbounded preceding), 2) equity from x")
def continued(spark, d):
    x = S.ledger(spark, d).withColumn("fwd", F.col("exit_time") >= F.lit("1998-01-01").cast("timestamp"))
    e = M.equity(x, ["instance"], ["fwd", "exit_time", "trade_id", "leg"], 3000.0, [F.col("fwd"), F.to_date("exit_time")])
    return e.select("instance", "trade_id", "leg", "fwd", F.round("equity", 2).alias("equity"))


@query("u01_union_all", "select c_custkey id, 'customer' kind from customer union all select s_suppkey, 'supplier' from supplier")
def union_all(spark, d):
    c = S.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"))
    return c.unionByName(S.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind")))


@query("u05_difference", "select distinct o_custkey from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def difference(spark, d):
    o = S.read(spark, d, "orders").select("o_custkey").distinct()
    return o.join(S.read(spark, d, "customer").filter("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")


@query("f03_labelled_lines", "select event_id, regexp_extract('Score: ' || floor(value + 0.5)::int || ' (' || event_type || ')', 'Score: ([0-9]+)', 1) score from events")
def labelled(spark, d):
    e = S.read(spark, d, "events")
    line = F.concat(F.lit("\x1b[32mScore: "), F.floor(F.col("value") + 0.5).cast("int").cast("string"), F.lit("\x1b[0m ("), F.col("event_type"), F.lit(")"))
    return e.select("event_id", F.regexp_extract(F.regexp_replace(line, "\x1b\\[[0-9;]*m", ""), "Score: ([0-9]+)", 1).alias("score"))


@query("f11_months", "select o_orderkey, strftime(cast(o_orderdate as date) + interval 6 month, '%Y-%m-%d') later from orders")
def months(spark, d):
    return S.read(spark, d, "orders").select("o_orderkey", F.date_format(F.add_months(F.to_date("o_orderdate"), 6), "yyyy-MM-dd").alias("later"))


@query("f12_ages", "with n as (select max(ts) t from events) select event_id, case when epoch(t) - epoch(ts) < 3600 then 'minutes' when epoch(t) - epoch(ts) < 86400 then 'hours' else 'days' end age from events, n")
def ages(spark, d):
    e = S.read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    s = F.col("t").cast("double") - F.col("ts").cast("double")
    return e.join(F.broadcast(e.agg(F.max("ts").alias("t")))).select("event_id", F.when(s < 3600, "minutes").when(s < 86400, "hours").otherwise("days").alias("age"))  # t is one row


@query("f15_arrays", f"{_L}, a as (select trade_id, list(pnl order by leg, pnl) v from ledger group by 1) select trade_id, len(v) n, round(list_sum(list_filter(v, lambda x: x > 0)), 2) gain, round(v[1], 2) first_pnl from a")
def arrays(spark, d):
    a = S.ledger(spark, d).groupBy("trade_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("leg", "pnl"))), lambda x: x["pnl"]).alias("v"))  # a trade has few legs
    gain = F.filter("v", lambda x: x > 0)
    return a.select("trade_id", F.size("v").cast("long").alias("n"), F.when(F.size(gain) > 0, F.round(F.aggregate(gain, F.lit(0.0), lambda s, x: s + x), 2)).alias("gain"), F.round(F.col("v")[0], 2).alias("first_pnl"))


@query("f19_tight_ranges", "with l as (select [5, 10, 15, 20, 30, 40, 50] vs), t as (select p_partkey, vs[1 + p_size % 7] v, 1 + p_size % 7 pos, vs from part, l) select p_partkey, v, array_to_string(vs[greatest(1, least(pos - 2, 3)) : greatest(1, least(pos - 2, 3)) + 4], ',') near from t")
def tight(spark, d):
    values = [5, 10, 15, 20, 30, 40, 50]
    listed = F.array(*map(F.lit, values))
    at = F.greatest(F.lit(1), F.least(F.array_position(listed, F.col("v")) - 2, F.lit(len(values) - 4))).cast("int")
    p = S.read(spark, d, "part").select("p_partkey", F.element_at(listed, (1 + F.col("p_size") % 7).cast("int")).alias("v"))
    return p.select("p_partkey", "v", F.array_join(F.slice(listed, at, 5), ",").alias("near"))


@query("i14_band_width", f"{_B}, x as (select sym, bar, avg(close) {_rows(30)} m, stddev_pop(close) {_rows(30)} s from bars) select sym, bar, round(case when m > 0 then 5 * s / m else 0 end, 4) width from x where bar >= 29")
def band_width(spark, d):
    mid, up, low = I.bollinger("close", 30, 2.5)
    x = B.in_blocks(S.bars_h1(spark, d), 30, lambda x: x.select("sym", "bar", mid.alias("m"), up.alias("u"), low.alias("l")).filter("bar >= 29"))
    return x.select("sym", "bar", F.round(F.when(F.col("m") > 0, (F.col("u") - F.col("l")) / F.col("m")).otherwise(0.0), 4).alias("width"))


@query("r02_mode_stops", "with t as (select p_partkey id, case when p_size % 2 = 0 then 'fixed' else 'atr' end sm, case p_size % 3 when 0 then 'rr' when 1 then 'atr' else 'fixed' end tm, p_size / 2.0::double atr from part), s as (select *, greatest(case when sm = 'fixed' then 25 else atr * 1.5::double end, 10) sl from t) select id, sl, greatest(case tm when 'rr' then sl * 2 when 'atr' then atr * 3 else 50 end, sl) tp from s")
def mode_stops(spark, d):
    size = F.col("p_size")
    t = S.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(size % 2 == 0, "fixed").otherwise("atr").alias("sm"), F.when(size % 3 == 0, "rr").when(size % 3 == 1, "atr").otherwise("fixed").alias("tm"), (size / 2.0).alias("atr"))
    sl, tp = P.mode_stops(F.col("sm"), F.col("tm"), F.lit(25.0), F.col("atr"), F.lit(1.5), F.lit(2.0), F.lit(3.0), F.lit(50.0))
    return t.select("id", sl.alias("sl"), tp.alias("tp"))


@query("m06_entry_slippage", f"{_B}, s as ({_donchian_sql(20)}) select sym, bar, round(price + direction * 0.5::double * 0.01::double, 6) entry from s where direction is not null")
def slippage(spark, d):
    return G.donchian(S.bars_h1(spark, d), 20).select("sym", "bar", F.round(P.slipped(F.col("direction"), F.col("price"), 0.5, F.lit(0.01)), 6).alias("entry"))


_TR = f"{_ORD}, {_EXIT}, tr as (select o.*, coalesce(x, zb) ex from o left join e on e.sym = o.sym and e.bar = o.bar join z on z.sym = o.sym)"
_HELD = _TR + """, hb as (select tr.sym, tr.bar, direction, b.bar at_, ex, direction * (b.close - price) / abs(price - sl) r, case when direction = 1 then b.high - price else price - b.low end / abs(price - sl) f, case when direction = 1 then price - b.low else b.high - price end / abs(price - sl) a from tr join bars b on b.sym = tr.sym and b.bar > tr.bar and b.bar <= ex where ex - tr.bar >= 3),
held as (select *, greatest(0, max(f) over w) mfe, greatest(0, max(a) over w) mae from hb window w as (partition by sym, bar order by at_ rows unbounded preceding))"""


def _held(spark, d):
    bars, s = _orders(spark, d)
    return bars, E.held_bars(X.first_exits(s, bars), bars)


@query("l01_held_bars", f"{_HELD} select sym, bar, at_ as at, round(r, 4) r_now, round(mfe, 4) mfe, round(mae, 4) mae from held")
def held(spark, d):
    return _held(spark, d)[1].select("sym", "bar", "at", F.round("r_now", 4).alias("r_now"), F.round("mfe", 4).alias("mfe"), F.round("mae", 4).alias("mae"))


@query("l03_labels", f"""{_HELD}, q as (select held.*, e.r reason, max(held.r) over (partition by held.sym, held.bar) top from held left join e on e.sym = held.sym and e.bar = held.bar),
p as (select sym, bar, min(at_) best_bar from q where r = top and top > 0 group by 1, 2)
select q.sym, q.bar, at_ as at, (ex - at_)::int bars_left, round(coalesce(lead(r, 5) over w, last_value(r) over v), 4) r_plus5, round(coalesce(lead(r, 10) over w, last_value(r) over v), 4) r_plus10,
  round(max(r) over v, 4) best_left, round(last_value(r) over v - r, 4) remaining_r, (coalesce(reason = 0, false) and ex > at_)::int stop_first, coalesce(best_bar, q.bar)::int best_bar
from q left join p on p.sym = q.sym and p.bar = q.bar window w as (partition by q.sym, q.bar order by at_), v as (partition by q.sym, q.bar order by at_ rows between current row and unbounded following)""")
def look_ahead(spark, d):
    x = E.labels(_held(spark, d)[1])
    whole = [F.col(c).cast("int").alias(c) for c in ("bars_left", "stop_first", "best_bar")]
    return x.select("sym", "bar", "at", *whole, *[F.round(c, 4).alias(c) for c in ("r_plus5", "r_plus10", "best_left", "remaining_r")])


@query("l08_l09_exit_scores", f"{_HELD}, sc as (select sym, at_ bar, max(least(1, mae) * 0.5::double + (1 - least(1, mfe)) * 0.5::double) score from held group by 1, 2) select bars.sym, bars.bar, round(coalesce(score, 0), 4) score from bars left join sc on sc.sym = bars.sym and sc.bar = bars.bar")
def exit_scores(spark, d):
    bars, h = _held(spark, d)
    score = E.exit_score("dual", F.least(F.lit(1.0), F.col("mfe")), F.least(F.lit(1.0), F.col("mae")))
    return E.scores_by_bar(h.withColumn("score", score), bars).select("sym", "bar", F.round("score", 4).alias("score"))


@query("l11_thresholds", f"{_L}, t(th) as (values (0.2::double), (0.4), (0.6), (0.8)), x as (select pnl, (leg % 10) / 10.0::double s from ledger) select th threshold, round(avg((s >= th)::int::double), 6) kept, round(avg(case when s >= th then pnl end), 3) mean from x, t group by 1 having avg((s >= th)::int::double) >= 0.3")
def calibration(spark, d):
    x = S.ledger(spark, d).withColumn("score", (F.col("leg") % 10) / 10.0)
    return E.calibrated(x, [0.2, 0.4, 0.6, 0.8], 0.3).select("threshold", F.round("kept", 6).alias("kept"), F.round("mean", 3).alias("mean"))


@query("l05_expanding_folds", f"{_B}, p as (select sym, bar, ntile(5) over (partition by sym order by bar) - 1 k from bars), f as (select sym, bar, k, range fold from p, range(4)) select sym, fold::int fold, case when k <= fold then 'train' else 'test' end as role, count(*) n from f where k <= fold + 1 group by all")
def expanding(spark, d):
    return E.folds(S.bars_h1(spark, d).select("sym", "bar"), 4).groupBy("sym", "fold", "role").agg(F.count("*").alias("n"))


@query("l13_adaptive_stops", "with t as (select o_orderkey, (o_orderkey % 100) / 100.0::double mae, o_orderkey % 400 n from orders) select o_orderkey, round(20 * (1 - case when mae < 0.5 then least(0.45::double, 1 - mae) else 0 end * greatest(0, least(1, (n - 100) / 200.0::double))), 4) sl from t")
def adaptive(spark, d):
    o = S.read(spark, d, "orders").select("o_orderkey", ((F.col("o_orderkey") % 100) / 100.0).alias("mae"), (F.col("o_orderkey") % 400).alias("n"))
    return o.select("o_orderkey", F.round(E.tightened_stop(F.col("mae"), F.col("n"), F.lit(20.0)), 4).alias("sl"))


@query("q02_underwater", f"{_L}, e as (select instance, trade_id, leg, exit_time, 3000 + sum(pnl) over (partition by instance order by exit_time, trade_id, leg rows unbounded preceding) eq from ledger) select instance, trade_id, leg, round(max(eq) over (partition by instance order by exit_time, trade_id, leg rows unbounded preceding) - eq, 2) under from e")
def underwater(spark, d):
    x = scan(S.ledger(spark, d), ["instance"], ["exit_time", "trade_id", "leg"], [F.to_date("exit_time")], sums={"gain": F.col("pnl")}, peaks={"top": ("gain", None)})
    now = F.col("gain_before") + F.col("pnl")
    return x.select("instance", "trade_id", "leg", F.round(F.greatest("top_before", now) - now, 2).alias("under"))


@query("q14_rejections", "select event_type, count(*) filter (value > 480) rejected, count(*) filter (value < 5) cancelled from events group by 1")
def rejections(spark, d):
    return S.read(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 480).alias("rejected"), F.count_if(F.col("value") < 5).alias("cancelled"))


@query("q16_verdicts", f"{_L}, t as (select pair, instance, sum(pnl) > 20000 green from ledger group by 1, 2) select pair, count(*) filter (green) green, count(*) n, count(*) filter (green) * 2 >= count(*) verdict from t group by 1")
def verdicts(spark, d):
    t = S.ledger(spark, d).groupBy("pair", "instance").agg((F.sum("pnl") > 20000).alias("green"))
    return t.groupBy("pair").agg(F.count_if("green").alias("green"), F.count("*").alias("n"), (F.count_if("green") * 2 >= F.count("*")).alias("verdict"))


@query("q12_parameter_conformance", "select l_orderkey, l_linenumber, case when abs(l_extendedprice / l_quantity / p_retailprice - 1) <= 0.15::double then 'ok' else 'off' end conform from lineitem join part on l_partkey = p_partkey")
def conformance(spark, d):
    j = S.read(spark, d, "lineitem").join(S.read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.select("l_orderkey", "l_linenumber", F.when(F.abs(F.col("l_extendedprice") / F.col("l_quantity") / F.col("p_retailprice") - 1) <= 0.15, "ok").otherwise("off").alias("conform"))


@query("q20_registry_filter", f"with {S.FLEET_SQL} select instance, nation from fleet where region in ('ASIA', 'EUROPE', 'REGION_1', 'REGION_2') and balance > 0")
def registry(spark, d):
    return S.fleet(spark, d).filter(F.col("region").isin("ASIA", "EUROPE", "REGION_1", "REGION_2") & (F.col("balance") > 0)).select("instance", "nation")


# --- models of each window from all rows before it ---

#: Bars of a walk-forward window.
WINDOW = 100


@query("l12_window_filter", f"""{_TR}, g as (select tr.sym, tr.bar, direction, coalesce(r = 1, false) win, tr.bar // {WINDOW} w, ex // {WINDOW} + 1 ready, (direction + 1) // 2 side, hour(b.ts) // 4 "hour", isodow(b.ts) - 1 "day", least(9, floor(abs(price - sl) / 10)) risk
  from (select tr.*, e.r from tr left join e on e.sym = tr.sym and e.bar = tr.bar) tr join bars b on b.sym = tr.sym and b.bar = tr.bar),
k as (select distinct sym, w from g),
p as (select k.sym, k.w, count(*) filter (win) yes, count(*) filter (not win) no from k join g on g.sym = k.sym and g.ready <= k.w group by 1, 2),
f as (select sym, bar, direction, w, ready, win, unnest(['side', 'hour', 'day', 'risk']) f, unnest([side::int, "hour"::int, "day"::int, risk::int]) b, unnest([2, 6, 7, 10]) size from g),
c as (select k.sym, k.w, f, b, count(*) filter (win) yes, count(*) filter (not win) no from k join f on f.sym = k.sym and f.ready <= k.w group by all),
s as (select f.sym, f.bar, f.direction, any_value(p.yes + p.no) n, any_value(ln((p.yes + 1) / (p.no + 1)::double)) + sum(ln((coalesce(c.yes, 0) + 1) / (p.yes + f.size)::double) - ln((coalesce(c.no, 0) + 1) / (p.no + f.size)::double)) score
  from f left join p on p.sym = f.sym and p.w = f.w left join c on c.sym = f.sym and c.w = f.w and c.f = f.f and c.b = f.b group by 1, 2, 3)
select sym, bar, direction, coalesce(n, 0) trained, round(case when n >= 20 then score end, 6) score, coalesce(case when n >= 20 then score end, 0) >= 0 kept from s""")
def window_filter(spark, d):
    """Signals kept by what all signals closed before their window tell; all are kept while there are too few."""
    bars, s = _orders(spark, d)
    x = X.first_exits(s, bars).join(bars.select("sym", "bar", "ts"), ["sym", "bar"]).withColumn("win", F.col("reason") == 1)
    bins = {
        "side": (F.floor((F.col("direction") + 1) / 2), 2), "hour": (F.floor(F.hour("ts") / 4), 6), "day": (F.weekday("ts"), 7),
        "risk": (F.least(F.lit(9), F.floor(F.abs(F.col("price") - F.col("sl")) / 10)), 10),
    }
    at = lambda c: F.floor(F.col(c) / WINDOW)
    y = W.classified(x, ["sym"], at("bar"), at("exit_bar") + 1, bins, F.col("win"))
    return y.select("sym", "bar", "direction", "trained", F.round("score", 6).alias("score"), (F.coalesce("score", F.lit(0.0)) >= 0).alias("kept"))


@query("l15_window_exit_model", f"""{_HELD}, y as (select sym, bar, at_, coalesce(lead(r, 5) over w, last_value(r) over v) - r gain, at_ // {WINDOW} w, least(at_ + 5, ex) // {WINDOW} + 1 ready, least(5, (at_ - bar - 1) // 8) * 9 + greatest(0, least(8, floor(r * 2) + 4)) cell
  from held window w as (partition by sym, bar order by at_), v as (partition by sym, bar order by at_ rows between current row and unbounded following)),
k as (select distinct sym, w from y),
p as (select k.sym, k.w, count(*) n, avg(gain) m from k join y on y.sym = k.sym and y.ready <= k.w group by 1, 2),
c as (select k.sym, k.w, cell, count(*) n, sum(gain) s from k join y on y.sym = k.sym and y.ready <= k.w group by 1, 2, 3)
select y.sym, y.bar, at_ as at, coalesce(p.n, 0) trained, round(case when p.n >= 200 then (coalesce(c.s, 0) + 20 * m) / (coalesce(c.n, 0) + 20) end, 5) value
from y left join p on p.sym = y.sym and p.w = y.w left join c on c.sym = y.sym and c.w = y.w and c.cell = y.cell""")
def window_exit_model(spark, d):
    """What holding on for five bars was worth, by age and result so far, in all bars known before a bar's window."""
    x = E.labels(_held(spark, d)[1])
    cell = F.least(F.lit(5), F.floor((F.col("age") - 1) / 8)) * 9 + F.greatest(F.lit(0), F.least(F.lit(8), F.floor(F.col("r_now") * 2) + 4))
    ready = F.floor(F.least(F.col("at") + 5, F.col("exit_bar")) / WINDOW) + 1
    y = W.predicted(x, ["sym"], F.floor(F.col("at") / WINDOW), ready, (cell, 54), F.col("r_plus5") - F.col("r_now"))
    return y.select("sym", "bar", "at", "trained", F.round("prediction", 5).alias("value"))


@query("l13_predicted_stops", f"""{_HELD}, u as (select held.sym, held.bar, direction, max(mae) mae, any_value(ex) ex from held group by 1, 2, 3),
y as (select u.sym, u.bar, u.mae, u.bar // {WINDOW} w, ex // {WINDOW} + 1 ready, abs(price - sl) risk, (u.direction + 1) // 2 * 6 + hour(b.ts) // 4 cell from u join o on o.sym = u.sym and o.bar = u.bar join bars b on b.sym = u.sym and b.bar = u.bar),
k as (select distinct sym, w from y),
p as (select k.sym, k.w, count(*) n, avg(mae) m from k join y on y.sym = k.sym and y.ready <= k.w group by 1, 2),
c as (select k.sym, k.w, cell, count(*) n, sum(mae) s from k join y on y.sym = k.sym and y.ready <= k.w group by 1, 2, 3),
q as (select y.sym, y.bar, risk, coalesce(p.n, 0) n, case when p.n >= 20 then (coalesce(c.s, 0) + 20 * m) / (coalesce(c.n, 0) + 20) end worst from y left join p on p.sym = y.sym and p.w = y.w left join c on c.sym = y.sym and c.w = y.w and c.cell = y.cell)
select sym, bar, n trained, round(worst, 5) worst, round(risk * (1 - greatest(0, least(1, (n - 100) / 200.0::double)) * (1 - greatest(0.5::double, coalesce(worst, 1) * 1.5))), 5) stop from q""")
def predicted_stops(spark, d):
    """Stops from the worst moves that all trades closed before a signal's window had, by side and hours."""
    bars, h = _held(spark, d)
    u = h.groupBy("sym", "bar", "direction", "price", "sl", "exit_bar").agg(F.max("mae").alias("worst")).join(bars.select("sym", "bar", "ts"), ["sym", "bar"])
    cell = F.floor((F.col("direction") + 1) / 2) * 6 + F.floor(F.hour("ts") / 4)
    y = W.predicted(u, ["sym"], F.floor(F.col("bar") / WINDOW), F.floor(F.col("exit_bar") / WINDOW) + 1, (cell, 12), F.col("worst"), least=20)
    stop = E.predicted_stop(F.coalesce("prediction", F.lit(1.0)), F.col("trained"), F.abs(F.col("price") - F.col("sl")))
    return y.select("sym", "bar", "trained", F.round("prediction", 5).alias("worst"), F.round(stop, 5).alias("stop"))
