"""Queries over the trade ledger: metrics, curves, histograms, streaks, portfolio."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import filters as P
from ..operators import metrics as M
from ..operators.selection import percentiles as percentiles_of
from ..sources import tables as S
from .registry import query

_L = f"with {S.LEDGER_SQL}"
ORDER = ["exit_time", "trade_id", "leg"]
#: Running sums over the ledger are carried from day to day.
DAYS = ["to_date(exit_time)"]
#: What is only summed up, from month to month: a day of an instance has little more than a trade.
MONTHS = ["trunc(exit_time, 'month')"]
_O = "order by exit_time, trade_id, leg"


@query("a02_trade_stats", f"{_L} select exit_reason, count(*) n, round(sum(pnl), 2) total, round(avg(pnl), 4) mean, min(pnl) worst, max(pnl) best from ledger group by 1")
def stats(spark, d):
    return S.ledger(spark, d).groupBy("exit_reason").agg(F.count("*").alias("n"), F.round(F.sum("pnl"), 2).alias("total"), F.round(F.avg("pnl"), 4).alias("mean"), F.min("pnl").alias("worst"), F.max("pnl").alias("best"))


@query("a03_medians", f"{_L} select pair, quantile_cont(pnl, 0.5) median from ledger group by 1")
def medians(spark, d):
    return percentiles_of(S.ledger(spark, d), ["pair"], "pnl", {"median": 0.5})


@query("a04_percentiles", f"{_L} select pair, round(quantile_cont(pnl, 0.05), 4) p5, round(quantile_cont(pnl, 0.25), 4) p25, round(quantile_cont(pnl, 0.75), 4) p75, round(quantile_cont(pnl, 0.95), 4) p95 from ledger group by 1")
def percentiles(spark, d):
    x = percentiles_of(S.ledger(spark, d), ["pair"], "pnl", {f"p{q}": q / 100 for q in (5, 25, 75, 95)})
    return x.select("pair", *[F.round(c, 4).alias(c) for c in x.columns[1:]])


@query("a05_a06_a07_deviations", f"{_L} select pair, round(stddev_pop(pnl), 4) pop, round(case when count(*) > 1 then stddev_samp(pnl) else 1 end, 4) samp, round(sqrt(sum(case when pnl < 0 then pnl * pnl else 0 end) / count(*)), 4) down from ledger group by 1")
def deviations(spark, d):
    down = F.sqrt(F.sum(F.when(F.col("pnl") < 0, F.col("pnl") * F.col("pnl")).otherwise(0.0)) / F.count("*"))
    return S.ledger(spark, d).groupBy("pair").agg(F.round(F.stddev_pop("pnl"), 4).alias("pop"), F.round(F.when(F.count("*") > 1, F.stddev_samp("pnl")).otherwise(1.0), 4).alias("samp"), F.round(down, 4).alias("down"))


_EQ = f"eq as (select *, row_number() over w n, 3000 + sum(pnl) over w equity, greatest(3000, max(e) over w) peak from (select *, 3000 + sum(pnl) over (partition by instance {_O} rows unbounded preceding) e from ledger) window w as (partition by instance {_O} rows unbounded preceding))"
_SUM = f"""a as (select instance, count(*) trades, count(*) filter (pnl > 0) wins, sum(pnl) profit, sum(case when pnl > 0 then pnl else 0 end) gw, sum(case when pnl <= 0 then -pnl else 0 end) gl, avg(pnl) m, stddev_samp(pnl) sd,
  sqrt(avg(case when pnl < 0 then pnl * pnl else 0 end)) dn, regr_r2(equity, n) r2, max((peak - equity) * 100 / peak) max_dd, sqrt(avg(((peak - equity) * 100 / peak) ** 2)) ulcer from eq group by 1),
b as (select *, wins * 100 / trades win_rate, case when gl > 0.01 then gw / gl when gw > 0 then 100 else 0 end pf, sqrt(trades * 252 / 2400.0::double) yr, case when trades < 3 then 0 else greatest(0, least(1, coalesce(r2, 0))) end rsq, profit * 100 / 3000 ret from a),
s as (select *, case when sd > 0 then yr * m / sd else 0 end sharpe, case when dn > 0 then least(20, yr * m / dn) when m > 0 then 20 else 0 end sortino, case when profit > 0 then profit * rsq * least(pf, 10) * sqrt(trades) / (max_dd + 5) else 0 end ontester from b)"""


@query("k01_k08_summary", f"{_L}, {_EQ}, {_SUM} select instance, trades, round(win_rate, 4) win_rate, round(pf, 4) profit_factor, round(sharpe, 4) sharpe, round(sortino, 4) sortino, round(rsq, 4) r_squared, round(max_dd, 3) max_dd, round(ulcer, 3) ulcer, round(ret, 3) total_return, round(ontester, 1) ontester, round(case when sortino <= 0 or pf <= 0 or rsq <= 0 then 0 else least(sortino, 20) * rsq * least(pf, 5) * sqrt(least(trades, 200)) * (1 + least(greatest(ret, 0), 200) / 100) / (ulcer + max_dd / 2 + 5) end, 4) quality from s")
def summary(spark, d):
    s = M.summary(S.ledger(spark, d), ["instance"], ORDER, 3000.0, 2400, 252, DAYS)
    digits = {"max_dd": 3, "ulcer": 3, "total_return": 3, "ontester": 1}
    return s.select("instance", "trades", *[F.round(c, digits.get(c, 4)).alias(c) for c in s.columns if c not in ("instance", "trades")])


@query("k04_ulcer_by_day", f"{_L}, {_EQ}, x as (select instance, cast(exit_time as date) dt, arg_max((peak - equity) * 100 / peak, n) dd from eq group by 1, 2), h as (select *, coalesce(lead(dt) over (partition by instance order by dt) - dt, 1) held from x) select instance, round(sqrt(sum(dd * dd * held) / sum(held)), 4) ulcer, sum(held)::bigint as days from h group by 1")
def ulcer_by_day(spark, d):
    x = M.ulcer_by_day(S.ledger(spark, d), ["instance"], ORDER, "exit_time", 3000.0, DAYS)
    return x.select("instance", F.round("ulcer", 4).alias("ulcer"), F.col("days").cast("long").alias("days"))


@query("k05_w09_equity", f"{_L}, {_EQ} select instance, n, round(equity, 2) equity, round(peak, 2) peak, round(peak - equity, 2) drawdown from eq")
def equity(spark, d):
    return M.equity(S.ledger(spark, d), ["instance"], ORDER, 3000.0, DAYS).select("instance", "n", F.round("equity", 2).alias("equity"), F.round("peak", 2).alias("peak"), F.round("drawdown", 2).alias("drawdown"))


@query("k09_recovery", f"{_L}, {_EQ} select instance, round(sum(pnl) / nullif(max(peak - equity), 0), 4) recovery from eq group by 1")
def recovery(spark, d):
    return M.equity(S.ledger(spark, d), ["instance"], ORDER, 3000.0, DAYS).groupBy("instance").agg(F.round(F.try_divide(F.sum("pnl"), F.max("drawdown")), 4).alias("recovery"))


@query("a09_r_squared", f"{_L}, {_EQ} select instance, round(greatest(0, least(1, coalesce(regr_r2(equity, n), 0))), 6) r2 from eq group by 1")
def r_squared(spark, d):
    return M.equity(S.ledger(spark, d), ["instance"], ORDER, 3000.0, DAYS).groupBy("instance").agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.regr_r2("equity", "n"), F.lit(0.0)))), 6).alias("r2"))


@query("k10_live_performance", f"{_L}, r as (select *, sum(pnl) over (partition by instance {_O} rows unbounded preceding) run from ledger), p as (select *, greatest(0, max(run) over (partition by instance {_O} rows unbounded preceding)) peak from r) select instance, count(*) trades, count(*) filter (pnl > 0) wins, count(*) filter (pnl < 0) losses, round(case when sum(case when pnl < 0 then -pnl else 0 end) > 0 then sum(case when pnl > 0 then pnl else 0 end) / sum(case when pnl < 0 then -pnl else 0 end) else 999 end, 4) pf, round(max(case when peak > 0 then (peak - run) * 100 / peak else 0 end), 3) dd_pct, round(count(*) / (date_diff('day', min(exit_time), max(exit_time)) / 30.44::double), 4) per_month from p group by 1 having date_diff('day', min(exit_time), max(exit_time)) > 1")
def live_performance(spark, d):
    x = M.equity(S.ledger(spark, d), ["instance"], ORDER, 0.0, DAYS).withColumnRenamed("equity", "run")
    gain, loss = F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0)), F.sum(F.when(F.col("pnl") < 0, -F.col("pnl")).otherwise(0.0))
    a = x.groupBy("instance").agg(
        F.count("*").alias("trades"), F.count_if(F.col("pnl") > 0).alias("wins"), F.count_if(F.col("pnl") < 0).alias("losses"), F.round(F.when(loss > 0, F.try_divide(gain, loss)).otherwise(999.0), 4).alias("pf"),
        F.round(F.max(F.when(F.col("peak") > 0, F.try_divide((F.col("peak") - F.col("run")) * 100, F.col("peak"))).otherwise(0.0)), 3).alias("dd_pct"), F.datediff(F.max("exit_time"), F.min("exit_time")).alias("days"),
    )
    return a.filter("days > 1").withColumn("per_month", F.round(F.col("trades") / (F.col("days") / 30.44), 4)).drop("days")


@query("a10_daily", f"{_L} select strftime(exit_time, '%Y-%m-%d') as \"day\", count(*) trades, count(*) filter (pnl > 0) wins, round(sum(pnl), 2) pnl from ledger group by 1")
def daily(spark, d):
    return S.ledger(spark, d).groupBy(F.date_format("exit_time", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("trades"), F.count_if(F.col("pnl") > 0).alias("wins"), F.round(F.sum("pnl"), 2).alias("pnl"))


@query("a11_portfolio_curve", f"{_L}, x as (select cast(exit_time as date) dt, round(sum(pnl), 2) pnl from ledger group by 1) select strftime(dt, '%Y-%m-%d') as \"day\", pnl, round(sum(pnl) over (order by dt), 2) total from x")
def portfolio(spark, d):
    x = S.ledger(spark, d).groupBy(F.to_date("exit_time").alias("dt")).agg(F.round(F.sum("pnl"), 2).alias("pnl"))
    # one row a day of all instances together
    total = F.sum("pnl").over(Window.orderBy("dt").rowsBetween(Window.unboundedPreceding, 0))
    return x.select(F.date_format("dt", "yyyy-MM-dd").alias("day"), "pnl", F.round(total, 2).alias("total"))


@query("a12_a13_year_month", f"{_L} select year(entry_time)::int y, month(entry_time)::int m, count(*) n, round(sum(pnl), 2) pnl from ledger group by rollup (1, 2)")
def year_month(spark, d):
    return S.ledger(spark, d).rollup(F.year("entry_time").alias("y"), F.month("entry_time").alias("m")).agg(F.count("*").alias("n"), F.round(F.sum("pnl"), 2).alias("pnl"))


@query("q03_heatmap", f"{_L} select year(entry_time)::int y, " + ", ".join(f'round(sum(case when month(entry_time) = {m} then pnl end), 2) "{m}"' for m in range(1, 13)) + " from ledger group by 1")
def heatmap(spark, d):
    return S.ledger(spark, d).withColumn("m", F.month("entry_time")).groupBy(F.year("entry_time").alias("y")).pivot("m", list(range(1, 13))).agg(F.round(F.sum("pnl"), 2))


@query("a14_hours", "with b as (select range::int bucket from range(24)), e as (select hour(ts)::int bucket, count(*) trades, round(sum(value), 2) pnl from events where event_type = 'click' group by 1) select bucket, coalesce(trades, 0) trades, coalesce(pnl, 0) pnl from b left join e using (bucket)")
def hours(spark, d):
    t = S.ticks(spark, d).filter("sym = 'click'").select("ts", F.col("price").alias("pnl"))
    return M.histogram(t, F.hour("ts"), 24).withColumn("pnl", F.round("pnl", 2))


@query("a15_weekdays", f"{_L}, b as (select range::int bucket from range(7)), e as (select (isodow(exit_time) - 1)::int bucket, count(*) trades, round(sum(pnl), 2) pnl from ledger group by 1) select bucket, coalesce(trades, 0) trades, coalesce(pnl, 0) pnl from b left join e using (bucket)")
def weekdays(spark, d):
    return M.histogram(S.ledger(spark, d), F.weekday("exit_time"), 7).withColumn("pnl", F.round("pnl", 2))


@query("a16_direction_cube", f"{_L} select direction, pnl > 0 win, count(*) n from ledger group by cube (1, 2)")
def cube(spark, d):
    return S.ledger(spark, d).withColumn("win", F.col("pnl") > 0).cube("direction", "win").agg(F.count("*").alias("n"))


@query("a17_exit_reasons", f"{_L} select exit_reason, count(*) n, round(count(*) filter (pnl > 0) * 100 / count(*), 4) win_rate from ledger group by 1")
def exits(spark, d):
    return S.ledger(spark, d).groupBy("exit_reason").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("pnl") > 0) * 100 / F.count("*"), 4).alias("win_rate"))


@query("a18_histogram", f"{_L}, r as (select min(pnl) lo, max(pnl) hi, greatest(10, least(50, count(distinct pnl) // 5)) k from ledger) select least(floor((pnl - lo) / ((hi - lo) / k)), k - 1)::int bin, count(*) n from ledger, r group by 1")
def bins(spark, d):
    x = S.ledger(spark, d)
    r = x.agg(F.min("pnl").alias("lo"), F.max("pnl").alias("hi"), F.greatest(F.lit(10), F.least(F.lit(50), F.floor(F.countDistinct("pnl") / 5))).alias("k"))
    at = F.least(F.floor((F.col("pnl") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / F.col("k"))), F.col("k") - 1).cast("int")
    return x.join(F.broadcast(r)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # r is one row


@query("a19_distinct", f"{_L} select pair, count(distinct instance) instances, count(distinct trade_id) groups from ledger group by 1")
def distinct(spark, d):
    return S.ledger(spark, d).groupBy("pair").agg(F.countDistinct("instance").alias("instances"), F.countDistinct("trade_id").alias("groups"))


@query("a20_group_pnl", f"{_L} select trade_id, count(*) legs, round(sum(pnl), 2) pnl from ledger group by 1")
def groups(spark, d):
    return S.ledger(spark, d).groupBy("trade_id").agg(F.count("*").alias("legs"), F.round(F.sum("pnl"), 2).alias("pnl"))


@query("a24_win_rate_z", f"{_L}, x as (select instance, count(*) n, avg((pnl > 0)::int::double) wr from ledger group by 1) select instance, round((wr - 0.5) / sqrt(0.25::double / n), 4) z, abs((wr - 0.5) / sqrt(0.25::double / n)) < 1.96 ok from x")
def z_test(spark, d):
    x = S.ledger(spark, d).groupBy("instance").agg(F.count("*").alias("n"), F.avg((F.col("pnl") > 0).cast("double")).alias("wr"))
    z = (F.col("wr") - 0.5) / F.sqrt(0.25 / F.col("n"))
    return x.select("instance", F.round(z, 4).alias("z"), (F.abs(z) < 1.96).alias("ok"))


@query("a27_shortfall", f"{_L}, v as (select instance, quantile_cont(pnl, 0.05) var from ledger group by 1) select l.instance, round(any_value(var), 4) var, round(avg(pnl), 1) shortfall from ledger l join v on l.instance = v.instance where pnl <= var group by 1")
def shortfall(spark, d):
    x = S.ledger(spark, d)
    v = percentiles_of(x, ["instance"], "pnl", {"var": 0.05})
    return x.join(v, "instance").filter("pnl <= var").groupBy("instance").agg(F.round(F.first("var"), 4).alias("var"), F.round(F.avg("pnl"), 1).alias("shortfall"))


@query("a28_auc", f"{_L}, r as (select exit_reason, (pnl > 0)::int y, avg(k) over (partition by exit_reason, s) rk from (select exit_reason, pnl, leg s, row_number() over (partition by exit_reason order by leg) k from ledger)), g as (select exit_reason, sum(rk * y) sr, sum(y) p, count(*) - sum(y) q from r group by 1) select exit_reason, round((sr - p * (p + 1) / 2) / (p * q), 6) auc from g where p > 0 and q > 0")
def auc(spark, d):
    x = S.ledger(spark, d)
    # ranks of a whole-number score from counts of its values: no sort of all rows
    v = x.groupBy("exit_reason", "leg").agg(F.count("*").alias("n"), F.count_if(F.col("pnl") > 0).alias("pos"))
    w = Window.partitionBy("exit_reason").orderBy("leg").rowsBetween(Window.unboundedPreceding, -1)
    v = v.withColumn("rank", F.coalesce(F.sum("n").over(w), F.lit(0)) + (F.col("n") + 1) / 2)
    g = v.groupBy("exit_reason").agg(F.sum(F.col("rank") * F.col("pos")).alias("sr"), F.sum("pos").alias("p"), (F.sum("n") - F.sum("pos")).alias("q"))
    return g.filter("p > 0 and q > 0").select("exit_reason", F.round((F.col("sr") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q")), 6).alias("auc"))


@query("w12_streaks", f"{_L}, x as (select instance, pnl > 0 win, row_number() over (partition by instance {_O}) - row_number() over (partition by instance, pnl > 0 {_O}) run from ledger), r as (select instance, win, run, count(*) n from x group by all) select instance, coalesce(max(n) filter (win), 0) win_streak, coalesce(max(n) filter (not win), 0) loss_streak from r group by 1")
def streaks(spark, d):
    return M.streaks(S.ledger(spark, d), ["instance"], ORDER, MONTHS)


_DESC = "order by exit_time desc, trade_id desc, leg desc"


@query("w13_closing_losses", f"{_L}, x as (select instance, row_number() over (partition by instance {_DESC}) age, min((pnl < 0)::int) over (partition by instance {_DESC} rows unbounded preceding) still from ledger) select instance, sum(still)::bigint streak, sum(still) >= 3 alert from x where age <= 20 group by 1")
def closing(spark, d):
    return M.closing_losses(S.ledger(spark, d), ["instance"], ORDER)


@query("w14_expected_streak", f"{_L}, x as (select instance, count(*) n, avg((pnl <= 0)::int::double) q from ledger group by 1) select instance, round(ln(n) / abs(ln(q)), 4) expected from x where q > 0 and q < 1")
def expected_streak(spark, d):
    x = S.ledger(spark, d).groupBy("instance").agg(F.count("*").alias("n"), F.avg((F.col("pnl") <= 0).cast("double")).alias("q"))
    return x.filter("q > 0 and q < 1").select("instance", F.round(F.ln("n") / F.abs(F.ln("q")), 4).alias("expected"))


@query("o02_top_instances", f"{_L} select instance, round(sum(pnl), 2) pnl from ledger group by 1 order by sum(pnl) desc, instance limit 10")
def top(spark, d):
    return S.ledger(spark, d).groupBy("instance").agg(S.total().alias("p")).orderBy(F.desc("p"), "instance").limit(10).select("instance", F.round("p", 2).alias("pnl"))


@query("o05_best_worst", f"{_L}, x as (select instance, sum(pnl) p from ledger group by 1), r as (select *, row_number() over (order by p desc, instance) b, row_number() over (order by p, instance) w from x) select instance, round(p, 2) pnl, case when b <= 3 then 'best' else 'worst' end side from r where b <= 3 or w <= 3")
def best_worst(spark, d):
    x = S.ledger(spark, d).groupBy("instance").agg(S.total().alias("p"))
    best = x.orderBy(F.desc("p"), "instance").limit(3).withColumn("side", F.lit("best"))
    worst = x.orderBy("p", "instance").limit(3).withColumn("side", F.lit("worst"))
    return best.unionByName(worst).select("instance", F.round("p", 2).alias("pnl"), "side")


@query("o06_best_of_each", f"{_L} select pair, arg_max(trade_id, (pnl, trade_id, leg)) best_trade, max(pnl) pnl from ledger group by 1")
def best_of(spark, d):
    return S.ledger(spark, d).groupBy("pair").agg(F.max_by("trade_id", F.struct("pnl", "trade_id", "leg")).alias("best_trade"), F.max("pnl").alias("pnl"))


@query("o04_last_trades", f"{_L} select instance, trade_id, leg, pnl from (select *, row_number() over (partition by instance {_DESC}) k from ledger) where k <= 5")
def last_trades(spark, d):
    w = Window.partitionBy("instance").orderBy(*[F.desc(c) for c in ORDER])
    return S.ledger(spark, d).withColumn("k", F.row_number().over(w)).filter("k <= 5").select("instance", "trade_id", "leg", "pnl")


@query("p24_penalty_ladder", f"{_L}, {_EQ}, {_SUM} select instance, round(case when trades < 450 then -100 + trades when m <= 0 then -300 when sharpe < 0 then -200 when max_dd > 50 then -150 when rsq < 0.3 then -125 else 1 end, 4) as value from s")
def ladder(spark, d):
    s = M.summary(S.ledger(spark, d), ["instance"], ORDER, 3000.0, 2400, 252, DAYS)
    one = F.when(F.col("total_return") <= 0, 0.0).otherwise(1.0)
    return s.select("instance", F.round(P.trial_value(F.col("trades"), one, F.col("sharpe"), F.col("max_dd"), F.col("r_squared"), least=450), 4).alias("value"))


@query("q04_directions", f"{_L} select pair, direction, count(*) n, count(*) filter (pnl > 0) wins, round(sum(pnl), 2) pnl from ledger group by 1, 2")
def directions(spark, d):
    return S.ledger(spark, d).groupBy("pair", "direction").agg(F.count("*").alias("n"), F.count_if(F.col("pnl") > 0).alias("wins"), F.round(F.sum("pnl"), 2).alias("pnl"))


@query("f01_pairs", "select distinct o_orderpriority pair, upper(replace(o_orderpriority, '-', '_')) tag, case when o_orderpriority like '%URG%' then 0.01::double else 0.0001::double end pip, split_part(o_orderpriority, '-', 1) rank from orders")
def pairs(spark, d):
    o = S.read(spark, d, "orders").select(F.col("o_orderpriority").alias("pair")).distinct()
    return o.select("pair", F.upper(F.regexp_replace("pair", "-", "_")).alias("tag"), F.when(F.col("pair").contains("URG"), 0.01).otherwise(0.0001).alias("pip"), F.split_part("pair", F.lit("-"), F.lit(1)).alias("rank"))


@query("p29_finite_only", f"{_L}, x as (select instance, pnl / nullif(leg - 1, 0) v from ledger) select instance, count(v) n, round(sum(coalesce(v, 0)), 2) total from x group by 1")
def finite(spark, d):
    v = F.try_divide(F.col("pnl"), F.col("leg") - 1)
    return S.ledger(spark, d).withColumn("v", v).groupBy("instance").agg(F.count("v").alias("n"), F.round(F.sum(F.coalesce("v", F.lit(0.0))), 2).alias("total"))


@query("p28_broken_trades", f"{_L} select instance, trade_id, leg from ledger where pnl = 0 and trade_id is not null")
def broken(spark, d):
    return S.ledger(spark, d).filter("pnl = 0 and trade_id is not null").select("instance", "trade_id", "leg")
