"""Queries for search, ranking, stability, walk-forward, Monte-Carlo, confidence and simulation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import filters as P
from ..operators import indicators as I
from ..operators import metrics as M
from ..operators import signals as G
from ..operators import simulate as X
from ..operators import validation as V
from ..operators.importance import importance
from ..operators.scans import place
from ..sources import tables as S
from .market import _donchian_sql
from .registry import query

_L = f"with {S.LEDGER_SQL}"
SPACE = {"channel_period": [10, 20, 40], "sl_atr_mult": [1.0, 1.5, 2.0], "tp_rr_ratio": [1.0, 2.0, 3.0], "trail_start": [10, 20], "trail_step": [5, 15]}
_GRID = "trials as (select (c + 3 * s + 9 * t + 27 * a + 54 * b)::bigint trial, [10, 20, 40][c + 1] channel_period, [1.0, 1.5, 2.0]::double[][s + 1] sl_atr_mult, [1.0, 2.0, 3.0]::double[][t + 1] tp_rr_ratio, [10, 20][a + 1] trail_start, [5, 15][b + 1] trail_step from range(3) x(c), range(3) y(s), range(3) z(t), range(2) u(a), range(2) v(b))".replace("[1.0, 1.5, 2.0]::double[]", "([1.0, 1.5, 2.0]::double[])").replace("[1.0, 2.0, 3.0]::double[]", "([1.0, 2.0, 3.0]::double[])")


@query("j14_parameter_grid", f"with {_GRID} select * from trials")
def grid(spark, d):
    return V.grid(spark, SPACE)


@query("p23_possible_trials", f"with {_GRID} select * from trials where trail_step <= trail_start")
def possible(spark, d):
    return P.possible(V.grid(spark, SPACE))


@query("o08_random_trials", f"with {_GRID} select trial from trials order by md5(concat_ws('-', 42, trial)) limit 20")
def random_trials(spark, d):
    return V.random_trials(V.grid(spark, SPACE), 20, 42).select("trial")


@query("x14_space_size", "select 'donchian' space, (3 * 3 * 3 * 2 * 2)::bigint size")
def space_size(spark, d):
    return V.grid(spark, SPACE).agg(F.count("*").alias("size")).select(F.lit("donchian").alias("space"), "size")


def _results(spark, d):
    """A result for each instance: profit before 1998 as back quality, and after it as forward quality."""
    early = F.col("exit_time") < F.lit("1998-01-01").cast("timestamp")
    return S.ledger(spark, d).groupBy(F.col("instance").alias("trial")).agg(S.mean(F.when(early, F.col("pnl"))).alias("back"), S.mean(F.when(~early, F.col("pnl"))).alias("forward")).filter("back is not null and forward is not null")


_RES = f"{_L}, res as (select * from (select instance trial, avg(case when exit_time < timestamp '1998-01-01' then pnl end) back, avg(case when exit_time >= timestamp '1998-01-01' then pnl end) forward from ledger group by 1) where back is not null and forward is not null)"


def _ranked(least: float) -> str:
    return f"""{_RES}, f as (select *, case when back > 0 then forward / back else 0 end ratio from res), ok as (select *, ratio >= {least}::double p, max((ratio >= {least}::double)::int) over () a from f),
k as (select trial, ratio, row_number() over (order by back desc, trial) back_rank, row_number() over (order by forward desc, trial) forward_rank from ok where p or a = 0), rk as (select *, back_rank + 2.0::double * forward_rank combined_rank from k)"""


@query("x06_combined_rank", f"{_ranked(0.4)} select trial, round(ratio, 6) ratio, back_rank, forward_rank, combined_rank from rk")
def combined(spark, d):
    return V.combined_rank(_results(spark, d), 2.0, 0.4).select("trial", F.round("ratio", 6).alias("ratio"), F.col("back_rank").cast("long").alias("back_rank"), F.col("forward_rank").cast("long").alias("forward_rank"), "combined_rank")


#: Parameters of a line item's trade, as a search over them would have tried.
_TRIED = {"status": "l_linestatus", "flag": "l_returnflag", "priority": "o_orderpriority", "line": "l_linenumber", "size": "floor(l_quantity / 10)::int"}
_TRY = f"r as (select {', '.join(f'cast({c} as varchar) {p}' for p, c in _TRIED.items())}, l_extendedprice * (l_discount - l_tax) y from lineitem join orders on l_orderkey = o_orderkey), w as (select count(*) t, avg(y) m, var_pop(y) v from r)"
_ONE = " union all ".join(f"select '{p}' p, {p} v, count(*) n, avg(y) y from r group by {p}" for p in _TRIED)
_TWO = " union all ".join(f"select '{p}' p, '{q}' q, {p} v, {q} u, count(*) n, avg(y) y from r group by {p}, {q}" for p, q in combinations(_TRIED, 2))


@query("x07_importance", f"""with {_TRY}, a as ({_ONE}), b as ({_TWO}),
c as (select b.p, b.q, b.n, b.y - f.y - g.y + m e from b join a f on f.p = b.p and f.v = b.v join a g on g.p = b.q and g.v = b.u, w)
select p as "first", null as "second", count(*) cells, round(sum(n * (y - m) ** 2) / any_value(t * w.v), 9) share from a, w group by p
union all select p, q, count(*), round(sum(n * e * e) / any_value(t * w.v), 9) from c, w group by p, q""")
def parameter_importance(spark, d):
    line, order = S.read(spark, d, "lineitem"), S.read(spark, d, "orders")
    x = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("y", F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax")))
    tried = x.select("y", *[F.expr(c.replace("::int", "")).alias(p) for p, c in _TRIED.items()])
    return importance(tried, list(_TRIED), "y").withColumn("share", F.round("share", 9))


@query("p25_ratio_filter_empty", f"{_ranked(1000)} select count(*) n from rk")
def ratio_empty(spark, d):
    return V.combined_rank(_results(spark, d), 2.0, 1000.0).agg(F.count("*").alias("n"))


@query("o03_diverse_top", f"{_ranked(0.1)}, s as (select *, trial % 7 sig from rk), q as (select *, row_number() over (partition by sig order by combined_rank, trial) k from s), z as (select *, case when k = 1 then 1 when k <= 2 then 2 else 3 end pass from q) select trial, sig, pass from z order by pass, combined_rank, trial limit 20")
def diverse(spark, d):
    x = V.combined_rank(_results(spark, d), 2.0, 0.1).withColumn("sig", F.col("trial") % 7)
    return V.diverse(x, ["sig"], 20, 2).select("trial", "sig", "pass")


@query("x08_neighbours", "with p as (select p_partkey, p_size::double v, 5.0::double lo, 45.0::double hi, p_size % 2 = 0 whole from part where p_size between 5 and 45), s as (select *, case when whole then greatest(1, floor(abs(v) * 0.1::double)) else abs(v) * 0.1::double end step from p), m as (select p_partkey, v, sg sign, least(hi, greatest(lo, v + sg * step)) moved from s, (values (-1), (1)) g(sg)) select p_partkey, v as value, sign, round(moved, 6) moved from m where moved <> v")
def neighbours(spark, d):
    size = F.col("p_size")
    p = S.read(spark, d, "part").filter(size.between(5, 45)).select("p_partkey", size.cast("double").alias("value"), F.lit(5.0).alias("low"), F.lit(45.0).alias("high"), (size % 2 == 0).alias("whole"))
    return V.neighbours(p).select("p_partkey", "value", "sign", F.round("moved", 6).alias("moved"))


@query("x09_stability", f"{_RES}, r as (select trial % 10 grp, case when back > 0 then forward / back else 0 end ratio from res), a as (select grp, avg(case when ratio > 0 then ratio end) mean, min(case when ratio > 0 then ratio end) least, count(*) filter (ratio > 0.7) stable, count(*) filter (ratio < 0.3) unstable from r group by 1) select grp, round(mean, 6) mean, round(least, 6) least, stable, unstable, case when mean >= 0.8 and least >= 0.5 then 'ROBUST' when mean >= 0.6 then 'MODERATE' when mean >= 0.4 then 'FRAGILE' else 'OVERFIT' end rating from a")
def stability(spark, d):
    r = _results(spark, d).select((F.col("trial") % 10).alias("grp"), F.when(F.col("back") > 0, F.try_divide("forward", "back")).otherwise(0.0).alias("ratio"))
    return V.stability(r, ["grp"]).withColumn("mean", F.round("mean", 6)).withColumn("least", F.round("least", 6))


_WIN = """sp as (select o_orderpriority sym, min(cast(o_orderdate as date)) f, max(cast(o_orderdate as date)) l from orders group by 1),
win as (select sym, k::int "window", f + to_months(6 + k::int * 3) ts0, f + to_months(12 + k::int * 3) ts1, f + to_months(18 + k::int * 3) ts2, l from sp, range(0, 40) r(k)),
w as (select sym, "window", cast(ts0 as date) train_start, cast(ts1 as date) train_end, cast(ts1 as date) test_start, least(cast(ts2 as date), l) test_end from win where ts2 <= l + interval 7 day)"""


def _windows(spark, d):
    o = S.read(spark, d, "orders")
    spans = o.groupBy(F.col("o_orderpriority").alias("sym")).agg(F.to_date(F.min("o_orderdate")).alias("first"), F.to_date(F.max("o_orderdate")).alias("last"))
    return V.windows(spans)


@query("v02_windows", f"with {_WIN} select sym, \"window\", strftime(train_start, '%Y-%m-%d') train_start, strftime(train_end, '%Y-%m-%d') train_end, strftime(test_start, '%Y-%m-%d') test_start, strftime(test_end, '%Y-%m-%d') test_end from w")
def windows(spark, d):
    w = _windows(spark, d)
    return w.select("sym", "window", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("train_start", "train_end", "test_start", "test_end")])


_WRES = f"with {S.LEDGER_SQL}, {_WIN}, x as (select sym, \"window\", avg(pnl) m, stddev_samp(pnl) s, count(*) n, test_start >= date '2000-01-01' oos from w join ledger on pair = sym and exit_time >= test_start and exit_time < test_end group by sym, \"window\", test_start), r as (select sym, \"window\", n, case when s > 0 then m / s * sqrt(12) else 0 end sharpe, n >= 5 and m > 500 passed, oos from x)"


def _window_results(spark, d):
    # windows are few for each instrument; the range condition is checked on the join by instrument
    w, t = _windows(spark, d), S.ledger(spark, d)
    j = t.join(w, (F.col("pair") == F.col("sym")) & (F.col("exit_time") >= F.col("test_start")) & (F.col("exit_time") < F.col("test_end")))
    x = j.groupBy("sym", "window", "test_start").agg(F.avg("pnl").alias("m"), F.stddev_samp("pnl").alias("s"), F.count("*").alias("n"))
    return x.select("sym", "window", "n", F.when(F.col("s") > 0, F.try_divide("m", "s") * F.sqrt(F.lit(12.0))).otherwise(0.0).alias("sharpe"), ((F.col("n") >= 5) & (F.col("m") > 500)).alias("passed"), (F.col("test_start") >= F.lit("2000-01-01").cast("date")).alias("oos"))


@query("v04_window_results", f"{_WRES} select sym, \"window\", n, round(sharpe, 5) sharpe, passed, oos from r")
def window_results(spark, d):
    return _window_results(spark, d).withColumn("sharpe", F.round("sharpe", 5))


@query("v05_v06_window_stats", f"{_WRES}, a as (select sym, count(*) n_windows, avg(passed::int::double) pass_rate, avg(sharpe) mean_sharpe, stddev_pop(sharpe) std_sharpe, count(*) filter (oos) oos_windows, avg(case when oos then passed::int::double end) op, avg(case when oos then sharpe end) os from r group by 1) select sym, n_windows, round(pass_rate, 5) pass_rate, round(mean_sharpe, 5) mean_sharpe, oos_windows, round(mean_sharpe / (std_sharpe + 0.01::double), 4) consistency, coalesce(op, pass_rate) >= 0.75 and coalesce(os, mean_sharpe) >= 0.5 gate from a")
def window_stats(spark, d):
    x = V.window_stats(_window_results(spark, d), ["sym"])
    return x.select("sym", "n_windows", F.round("pass_rate", 5).alias("pass_rate"), F.round("mean_sharpe", 5).alias("mean_sharpe"), "oos_windows", F.round("consistency", 4).alias("consistency"), "gate")


# --- resampling ---

#: Orders, draws and sign flips of a group, as the reference has them.
ITERATIONS = 1000


def _sample(spark, d):
    """The trades of every instance, numbered from 0."""
    x = place(S.ledger(spark, d), ["instance"], ["exit_time", "trade_id", "leg"], ["to_date(exit_time)"], "n")
    return x.select(F.col("instance").alias("grp"), (F.col("n") - 1).alias("n"), "pnl")


_SMP = f"{_L}, t as (select instance grp, row_number() over (partition by instance order by exit_time, trade_id, leg) - 1 n, pnl from ledger), it as (select range iter from range({ITERATIONS}))"


def _hash(kind: str) -> str:
    return f"('0x' || substr(md5(concat_ws('-', '{kind}', iter, grp, n)), 1, 8))::ubigint::bigint"


@query("v07_shuffle", f"{_SMP}, x as (select grp, iter, n, pnl, {_hash('s42')} draw from t, it), e as (select *, 3000 + sum(pnl) over (partition by grp, iter order by draw, n rows unbounded preceding) eq from x), p as (select *, greatest(3000, max(eq) over (partition by grp, iter order by draw, n rows unbounded preceding)) pk from e) select grp, iter::int iter, round(sum(pnl) * 100 / 3000, 4) ret, round(max((pk - eq) * 100 / pk), 3) max_dd from p group by 1, 2")
def shuffle(spark, d):
    return V.shuffled(_sample(spark, d), ITERATIONS, 3000.0).select("grp", "iter", F.round("ret", 4).alias("ret"), F.round("max_dd", 3).alias("max_dd"))


_BOOT = f"{_SMP}, x as (select t.grp, iter, {_hash('b12345')} % z pick from t join (select grp g, count(*) z from t group by 1) on g = grp, it), y as (select x.grp, iter, pnl from x join t on t.grp = x.grp and t.n = pick), b as (select grp, iter, avg(pnl) m, stddev_samp(pnl) s, count(*) c, count(*) filter (pnl > 0) * 100 / count(*) wr, sum(case when pnl > 0 then pnl else 0 end) w, sum(case when pnl <= 0 then -pnl else 0 end) l from y group by 1, 2), bs as (select grp, iter, case when s > 0 then m / s * sqrt(c) else 0 end sharpe, wr win_rate, case when l > 0.01 then w / l else 100 end pf from b)"


@query("v08_bootstrap", f"{_BOOT} select grp, iter::int iter, round(sharpe, 5) sharpe, round(win_rate, 5) win_rate, round(pf, 5) profit_factor from bs")
def bootstrap(spark, d):
    return V.bootstrapped(_sample(spark, d), ITERATIONS).select("grp", "iter", *[F.round(c, 5).alias(c) for c in ("sharpe", "win_rate", "profit_factor")])


@query("v09_permutation", f"{_SMP}, x as (select grp, iter, case when {_hash('p54321')} % 2 = 0 then pnl else -pnl end f from t, it), s as (select grp, iter, avg(f) / stddev_samp(f) sc from x group by 1, 2), o as (select grp, avg(pnl) / stddev_samp(pnl) own from t group by 1) select s.grp, round(avg((sc >= own)::int::double), 6) p_value from s join o on s.grp = o.grp group by 1")
def permutation(spark, d):
    return V.permutation(_sample(spark, d), ITERATIONS).select("grp", F.round("p_value", 6).alias("p_value"))


@query("v10_group_shuffle", f"{_L}, g as (select instance grp, trade_id, min(exit_time) et, sum(pnl) pnl from ledger group by 1, 2), t as (select grp, row_number() over (partition by grp order by et, trade_id) - 1 n, pnl from g), it as (select range iter from range({ITERATIONS})), x as (select grp, iter, n, pnl, {_hash('s42')} draw from t, it), e as (select *, 3000 + sum(pnl) over (partition by grp, iter order by draw, n rows unbounded preceding) eq from x), p as (select *, greatest(3000, max(eq) over (partition by grp, iter order by draw, n rows unbounded preceding)) pk from e) select grp, iter::int iter, round(max((pk - eq) * 100 / pk), 3) max_dd from p group by 1, 2")
def group_shuffle(spark, d):
    g = S.ledger(spark, d).groupBy(F.col("instance").alias("grp"), "trade_id").agg(F.min("exit_time").alias("et"), F.sum("pnl").alias("pnl"))
    t = place(g, ["grp"], ["et", "trade_id"], ["to_date(et)"], "n").select("grp", (F.col("n") - 1).alias("n"), "pnl")
    return V.shuffled(t, ITERATIONS, 3000.0).select("grp", "iter", F.round("max_dd", 3).alias("max_dd"))


@query("v11_distribution", f"{_BOOT}, p as (select grp, quantile_cont(sharpe, 0.05) p5, quantile_cont(sharpe, 0.5) p50, quantile_cont(sharpe, 0.95) p95, avg((sharpe > 0)::int::double) above0 from bs group by 1), s as (select bs.grp, avg(sharpe) sf from bs join p on p.grp = bs.grp where sharpe <= p5 group by 1) select p.grp, round(p5, 5) p5, round(p50, 5) p50, round(p95, 5) p95, round(sf, 5) shortfall, round(above0, 5) above0 from p join s on s.grp = p.grp")
def distribution(spark, d):
    x = V.distribution(V.bootstrapped(_sample(spark, d), ITERATIONS), "sharpe", ["grp"])
    return x.select("grp", *[F.round(c, 5).alias(c) for c in ("p5", "p50", "p95", "shortfall", "above0")])


# --- confidence ---

#: Columns of candidates, made from the keys of the orders.
_CCOLS = {
    "profit_factor": "1 + k % 23 / 10.0", "sortino": "k % 31 / 8.0", "r_squared": "k % 11 / 10.0", "trades": "20 + k % 90", "max_dd": "k % 61 / 1.0", "ulcer": "k % 29 / 1.0", "ratio": "k % 27 / 10.0", "pass_rate": "k % 9 / 8.0", "oos_windows": "k % 4", "oos_pass_rate": "k % 7 / 6.0",
    "mean_sharpe": "k % 13 / 6.0", "oos_mean_sharpe": "k % 17 / 8.0", "consistency": "k % 19 / 6.0", "mean_stability": "k % 12 / 10.0", "unstable": "k % 6", "sharpe_low": "k % 21 / 10.0", "pf_low": "k % 15 / 10.0", "quality": "k % 37 / 9.0", "back_quality": "k % 25 / 20.0",
}
_CLIP = lambda x: f"greatest(0, least(100, {x}))"


@query("v12_v13_confidence", f"""with o as (select o_orderkey k from orders), c as (select k id, k % 2 = 0 significant, {', '.join(f"({e.replace('.0', '.0::double')}) {n}" for n, e in _CCOLS.items())} from o),
p as (select *, ({_CLIP('(profit_factor - 1) * 100 / 2')} + {_CLIP('sortino * 100 / 3')} + {_CLIP('r_squared * 100 / 0.9::double')} + {_CLIP('(trades - 30) * 100 / 70')} + {_CLIP('(30 - (ulcer + max_dd / 2)) / 30 * 100')}) / 5 bt,
 case when ratio <= 0 then 0 when ratio <= 1 then ratio * 100 when ratio <= 2 then 100 else greatest(0, 100 - (ratio - 2) * 20) end fb,
 {_CLIP('(case when oos_windows > 0 then oos_pass_rate else pass_rate end) * 100 + least(10, greatest(-40, ((case when oos_windows > 0 then oos_mean_sharpe else mean_sharpe end) - 1) * 30))')} wf0,
 least(100, mean_stability * 100) * case when unstable > 3 then 0.8::double else 1 end st, {_CLIP('sharpe_low * 100 / 2')} mc0, least(quality / 3, 1) * 100 qs from c),
q as (select *, case when oos_windows = 1 then wf0 * 0.7::double + pass_rate * 100 * 0.3::double else wf0 end wf1, (case when pf_low > 1 then least(mc0 + 10, 100) else mc0 end) * case when significant then 1 else 0.5::double end mc from p),
r as (select *, case when consistency > 2 then least(wf1 + 10, 100) else wf1 end wf from q),
s as (select id, least(bt * 0.15::double + fb * 0.15::double + wf * 0.25::double + st * 0.15::double + mc * 0.15::double + qs * 0.15::double, 100, case when r_squared < 0.3 then 50 else 1000 end, case when max_dd > 50 then 40 else 1000 end, case when back_quality > 0 and back_quality < 0.5 then 50 else 1000 end, case when ulcer > 20 then 40 when ulcer > 10 then 70 else 1000 end) score from r)
select id, round(score + 1e-9::double, 4) score, case when score >= 70 then 'GREEN' when score >= 40 then 'YELLOW' else 'RED' end rating from s""")
def confidence(spark, d):
    k = S.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    c = k.select(F.col("k").alias("id"), (F.col("k") % 2 == 0).alias("significant"), *[F.expr(e.replace(".0", "D").replace("/ 1D", "/ 1.0D")).alias(n) for n, e in _CCOLS.items()])
    return V.confidence(c).select("id", F.round(F.col("score") + 1e-9, 4).alias("score"), "rating")


# --- simulation ---


def _orders(spark, d):
    """Donchian signals with stops of two and targets of three average ranges, in price."""
    bars = S.bars_h1(spark, d)
    ranged = B.in_blocks(bars, 20, lambda x: x.select("sym", "bar", F.avg(F.col("high") - F.col("low")).over(I.frame(20)).alias("atr")))
    s = G.donchian(bars, 20).join(ranged, ["sym", "bar"]).filter("atr > 0")
    sl, tp = P.prices(F.col("direction"), F.col("price"), F.col("atr") * 0.2, F.col("atr") * 0.3, F.lit(1.0))
    return bars, s.select("sym", F.lit(0).alias("trial"), "bar", F.lit(0).alias("seq"), "direction", "price", sl.alias("sl"), tp.alias("tp"), "atr", F.lit(48).alias("max_bars"))


_ORD = f"with {S.BARS_SQL}, rg as (select sym, bar, avg(high - low) over (partition by sym order by bar rows between 19 preceding and current row) atr from bars), sg as ({_donchian_sql(20)}), o as (select sg.sym, sg.bar, direction, price, price - direction * (atr * 0.2::double) sl, price + direction * (atr * 0.3::double) tp from sg join rg on sg.sym = rg.sym and sg.bar = rg.bar where direction is not null and atr > 0)"
_EXIT = """h as (select o.sym, o.bar, b.bar at_, case when b.bar = o.bar + 48 then 3 when case when direction = 1 then b.low <= sl else b.high >= sl end then 0 when case when direction = 1 then b.high >= tp else b.low <= tp end then 1 end reason, b.close c from o join bars b on b.sym = o.sym and b.bar > o.bar and b.bar <= o.bar + 48),
e as (select sym, bar, min(at_) x, arg_min(reason, at_) r, arg_min(c, at_) c from h where reason is not null group by 1, 2), z as (select sym, max(bar) zb, arg_max(close, bar) zc from bars group by 1)"""


@query("j02_first_exits", f"{_ORD}, {_EXIT} select o.sym, o.bar, o.direction, coalesce(x, zb)::int exit_bar, coalesce(r, 6)::int reason, round(case when r = 0 then sl when r = 1 then tp when r = 3 then c else zc end, 6) exit_price from o left join e on e.sym = o.sym and e.bar = o.bar join z on z.sym = o.sym")
def first_exits(spark, d):
    bars, s = _orders(spark, d)
    return X.first_exits(s, bars).select("sym", "bar", "direction", "exit_bar", F.col("reason").cast("int").alias("reason"), F.round("exit_price", 6).alias("exit_price"))


@query("b01_basic_trades")
def basic_trades(spark, d):
    bars, s = _orders(spark, d)
    t = X.simulate(P.management_defaults(s), bars)
    return t.select("sym", "trial", "bar", "direction", "exit_bar", "reason", F.round("pnl", 4).alias("pnl"), F.round("equity", 4).alias("equity"))


@query("b01_relational_trades")
def relational_trades(spark, d):
    bars, s = _orders(spark, d)
    return X.relational(X.first_exits(s, bars)).select("sym", "trial", "bar", "direction", "exit_bar", "reason", F.round("equity", 4).alias("equity"))


@query("b04_managed_trades")
def managed_trades(spark, d):
    bars, s = _orders(spark, d)
    a = F.col("atr")
    m = s.withColumns({"be_trigger": a * 0.1, "be_offset": a * 0.02, "trail_start": a * 0.15, "trail_step": a * 0.1, "partial_pct": F.lit(0.5), "partial_target": a * 0.12, "stale_bars": F.lit(24)})
    t = X.simulate(P.management_defaults(m), bars, daily_trades=3, daily_loss=0.05)
    return t.select("sym", "trial", "bar", "direction", "exit_bar", "reason", "bars_held", F.round("pnl", 4).alias("pnl"), F.round("mfe_r", 4).alias("mfe_r"), F.round("mae_r", 4).alias("mae_r"))


@query("b05_grid_trades")
def grid_trades(spark, d):
    bars, s = _orders(spark, d)
    return X.simulate(P.management_defaults(s), bars, slots=11).select("sym", "trial", "bar", "direction", "exit_bar", "reason", F.round("pnl", 4).alias("pnl"))


@query("x01_grid_search")
def grid_search(spark, d):
    """Every possible trial of the space over all instruments, simulated at once and summed up by trial."""
    bars = S.bars_h1(spark, d)
    ranged = B.in_blocks(bars, 20, lambda x: x.select("sym", "bar", F.avg(F.col("high") - F.col("low")).over(I.frame(20)).alias("atr")))
    trials = P.possible(V.grid(spark, SPACE))
    s = G.donchian_variants(bars, SPACE["channel_period"]).join(ranged, ["sym", "bar"]).join(F.broadcast(trials), "channel_period").filter("atr > 0")  # the stated space is small
    sl, tp = P.prices(F.col("direction"), F.col("price"), F.col("atr") * F.col("sl_atr_mult") * 0.2, F.col("atr") * F.col("sl_atr_mult") * F.col("tp_rr_ratio") * 0.2, F.lit(1.0))
    pip = F.col("atr") * 0.2 / 35  # trailing is in pips, of which an average range has 35, and scaled like the stops
    o = s.select("sym", F.col("trial").cast("int").alias("trial"), "bar", F.lit(0).alias("seq"), "direction", "price", sl.alias("sl"), tp.alias("tp"), "atr", *[(F.col(c) * pip).alias(c) for c in ("trail_start", "trail_step")])
    t = X.simulate(P.management_defaults(o), bars)
    m = M.summary(t, ["trial"], ["exit_bar", "sym", "bar"], 3000.0, 700, 252 * 22)
    return m.select("trial", "trades", F.round("win_rate", 4).alias("win_rate"), F.round("profit_factor", 4).alias("profit_factor"), F.round("quality", 6).alias("quality"))
