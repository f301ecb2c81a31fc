"""Queries for reconciliation, the fleet, JSON and CSV documents, and management actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as P
from ..operators import matching as J
from ..operators import metrics as M
from ..operators.scans import scan
from ..sources import documents as D
from ..sources import tables as S
from .registry import query

_L = f"with {S.LEDGER_SQL}"


def _ends(spark, d):
    """Signals (clicks) and live fills (purchases or views) of users, as two streams of times."""
    e = S.read(spark, d, "events").select("event_id", "event_type", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"))
    kinds = "event_type in ('click', 'purchase')"
    e = e.filter(kinds)
    return e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'")


_ENDS = "a as (select event_id, user_id, ts, value price from events where event_type = 'click'), b as (select event_id, user_id, ts, value price from events where event_type = 'purchase')"


@query("j04_nearest_match", f"with {_ENDS}, m as (select a.event_id, b.event_id other, abs(epoch_us(b.ts) - epoch_us(a.ts)) / 1e6 gap from a left join b on a.user_id = b.user_id and abs(epoch_us(b.ts) - epoch_us(a.ts)) <= 21600000000), r as (select *, row_number() over (partition by event_id order by gap nulls last, other) k from m) select event_id, other, round(gap, 3) gap from r where k = 1")
def nearest(spark, d):
    a, b = _ends(spark, d)
    return J.nearest(a.select("event_id", "user_id", "ts"), b.select(F.col("event_id").alias("other"), "user_id", "ts"), ["user_id"], 6 * 3600, "event_id", "other").select("event_id", "other", F.round("gap", 3).alias("gap"))


@query("j06_scored_match", f"with {_ENDS}, m as (select a.event_id, b.event_id other, abs(epoch_us(b.ts) - epoch_us(a.ts)) / 1e6 + abs(a.price - b.price) * 100 score from a join b on a.user_id = b.user_id and abs(epoch_us(b.ts) - epoch_us(a.ts)) <= 86400000000), r as (select *, row_number() over (partition by event_id order by score, other) k from m) select event_id, other, round(score, 2) score from r where k = 1")
def scored(spark, d):
    a, b = _ends(spark, d)
    found = J.least_score(a, b.withColumnRenamed("event_id", "other"), ["user_id"], 86400, 100.0, "event_id", "other")
    return found.select("event_id", "other", F.round("score", 2).alias("score"))


@query("j10_last_before", "with y as (select event_id, event_type, last_value(case when event_type = 'click' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) last_click from events) select event_id, last_click from y where event_type = 'purchase'")
def last_before(spark, d):
    e = S.read(spark, d, "events")
    x = scan(e, ["user_id"], ["ts", "event_id"], [F.to_date("ts")], lasts={"click": F.when(F.col("event_type") == "click", F.col("event_id"))})
    return x.filter("event_type = 'purchase'").select("event_id", F.col("click_before").alias("last_click"))


@query("j08_event_pairing", "with x as (select event_id, user_id, event_type, lead(event_type) over w nt, lead(event_id) over w ni from events where event_type in ('click', 'purchase') window w as (partition by user_id order by ts, event_id)) select event_id entry_id, case when nt = 'purchase' then ni end exit_id from x where event_type = 'click'")
def pairing(spark, d):
    e = S.read(spark, d, "events").filter("event_type in ('click', 'purchase')")
    return J.pair_up(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "click", F.col("event_type") == "purchase", "event_id").select("entry_id", "exit_id")


@query("j16_fleet_star", f"with {S.LEDGER_SQL}, {S.FLEET_SQL}, t as (select instance, count(*) n, round(sum(pnl), 2) pnl from ledger where exit_time < timestamp '1996-01-01' group by 1) select fleet.instance, name, nation, region, coalesce(n, 0) trades, coalesce(pnl, 0) pnl from fleet left join t using (instance)")
def fleet_star(spark, d):
    t = S.ledger(spark, d).filter(F.col("exit_time") < F.lit("1996-01-01").cast("timestamp")).groupBy("instance").agg(F.count("*").alias("trades"), F.round(F.sum("pnl"), 2).alias("pnl"))
    return S.fleet(spark, d).join(t, "instance", "left").na.fill({"trades": 0, "pnl": 0.0}).select("instance", "name", "nation", "region", "trades", "pnl")


@query("j17_closed_elsewhere", "select o_orderkey from orders where o_orderstatus = 'O' and o_orderkey not in (select l_orderkey from lineitem where l_linestatus = 'O')")
def anti(spark, d):
    o = S.read(spark, d, "orders").filter("o_orderstatus = 'O'")
    return o.join(S.read(spark, d, "lineitem").filter("l_linestatus = 'O'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("j18_known_trades", "select o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')")
def semi(spark, d):
    o = S.read(spark, d, "orders")
    return o.join(S.read(spark, d, "lineitem").filter("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("j19_idempotent_archive", f"{_L}, n as (select cast(exit_time as date) dt, count(*) n, 1 source from ledger where exit_time < timestamp '1997-01-01' group by 1), u as (select cast(exit_time as date) dt, count(*) n, 2 source from ledger where exit_time >= timestamp '1996-06-01' group by 1) select strftime(dt, '%Y-%m-%d') as \"day\", n, source from n union all select strftime(dt, '%Y-%m-%d'), n, source from u where dt not in (select dt from n)")
def archive(spark, d):
    x = S.ledger(spark, d).withColumn("dt", F.to_date("exit_time"))
    daily = lambda df, k: df.groupBy("dt").agg(F.count("*").alias("n")).withColumn("source", F.lit(k))
    old = daily(x.filter(F.col("exit_time") < F.lit("1997-01-01").cast("timestamp")), 1)
    new = daily(x.filter(F.col("exit_time") >= F.lit("1996-06-01").cast("timestamp")), 2)
    return J.insert_missing(old, new, ["dt"]).select(F.date_format("dt", "yyyy-MM-dd").alias("day"), "n", "source")


@query("j20_q10_live_vs_expected", f"{_L}, e as (select instance, avg((pnl > 0)::int::double) x from ledger where exit_time < timestamp '1998-01-01' group by 1), l as (select instance, avg((pnl > 0)::int::double) y, count(*) n from ledger where exit_time >= timestamp '1998-01-01' group by 1) select e.instance, round(y / x, 6) ratio, case when n < 3 then 'few' when abs(y / x - 1) <= 0.1::double then 'ok' when abs(y / x - 1) <= 0.25::double then 'warning' else 'alert' end status from e join l on e.instance = l.instance where x > 0")
def expected(spark, d):
    x, cut = S.ledger(spark, d), F.lit("1998-01-01").cast("timestamp")
    win = F.avg((F.col("pnl") > 0).cast("double"))
    e = x.filter(F.col("exit_time") < cut).groupBy("instance").agg(win.alias("x"))
    live = x.filter(F.col("exit_time") >= cut).groupBy("instance").agg(win.alias("y"), F.count("*").alias("n"))
    j = e.join(live, "instance").filter("x > 0")
    off = F.abs(F.col("y") / F.col("x") - 1)
    return j.select("instance", F.round(F.col("y") / F.col("x"), 6).alias("ratio"), F.when(F.col("n") < 3, "few").when(off <= 0.1, "ok").when(off <= 0.25, "warning").otherwise("alert").alias("status"))


@query("j21_action_differences", "with a as (select l_orderkey k, l_linenumber n, l_returnflag act from lineitem where l_orderkey % 3 <> 0), b as (select l_orderkey k, l_linenumber n, case when l_linenumber = 2 then 'X' else l_returnflag end act from lineitem where l_orderkey % 3 <> 1) select coalesce(a.k, b.k) trade_id, coalesce(a.n, b.n) bar_number, coalesce(a.act, b.act) as \"action\", case when a.k is null then 'expected only' when b.k is null then 'actual only' else 'both' end side, count(*) rows from a full join b on a.k = b.k and a.n = b.n and a.act = b.act group by all")
def actions(spark, d):
    x = S.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("trade_id"), F.col("l_linenumber").alias("bar_number"), F.col("l_returnflag").alias("action"))
    actual = x.filter("trade_id % 3 <> 0")
    wanted = x.filter("trade_id % 3 <> 1").withColumn("action", F.when(F.col("bar_number") == 2, "X").otherwise(F.col("action")))
    return J.differences(actual, wanted, ["trade_id", "bar_number", "action"])


@query("a22_fleet_summary", f"with {S.LEDGER_SQL}, {S.FLEET_SQL}, t as (select instance, sum(pnl) p from ledger group by 1) select region, count(*) instances, count(*) filter (balance < 0) in_debt, count(*) filter (p > 100000) strong, round(sum(p), 2) pnl from fleet join t using (instance) group by 1")
def fleet_summary(spark, d):
    t = S.ledger(spark, d).groupBy("instance").agg(F.sum("pnl").alias("p"))
    return S.fleet(spark, d).join(t, "instance").groupBy("region").agg(F.count("*").alias("instances"), F.count_if(F.col("balance") < 0).alias("in_debt"), F.count_if(F.col("p") > 100000).alias("strong"), F.round(F.sum("p"), 2).alias("pnl"))


@query("q09_instance_labels", f"with {S.FLEET_SQL} select instance, concat_ws(' | ', name, nation, printf('%.0f', floor(balance))) as comment, regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g') tag from fleet")
def labels(spark, d):
    f = S.fleet(spark, d)
    return f.select("instance", F.concat_ws(" | ", "name", "nation", P.floored(F.col("balance"), 0)).alias("comment"), F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "_").alias("tag"))


@query("s12_json_documents", "select event_id, try_cast(json_extract_string(props, '$.k') as bigint) k from events")
def json_documents(spark, d):
    return D.parsed(S.read(spark, d, "events"), "props", "k long").select("event_id", "doc.k")


@query("a18_json_groups", "select try_cast(json_extract_string(props, '$.k') as bigint) k, count(*) n, round(sum(value), 2) total from events group by 1")
def json_groups(spark, d):
    x = D.parsed(S.read(spark, d, "events"), "props", "k long")
    return x.groupBy("doc.k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("f18_config_digests", "select o_orderkey, substr(sha256(concat_ws('|', o_orderkey, o_orderstatus, o_orderpriority)), 1, 12) digest from orders")
def digests(spark, d):
    return S.read(spark, d, "orders").select("o_orderkey", F.substring(F.sha2(F.concat_ws("|", "o_orderkey", "o_orderstatus", "o_orderpriority"), 256), 1, 12).alias("digest"))


@query("t10_risk_gates", f"{_L}, x as (select instance, trade_id, leg, exit_time, pnl, sum(pnl) over (partition by instance order by exit_time, trade_id, leg rows unbounded preceding) run from ledger), p as (select *, greatest(0, max(run) over (partition by instance order by exit_time, trade_id, leg rows unbounded preceding)) peak from x), g as (select *, case when peak - run > 20000 then 'drawdown' when pnl < -6000 then 'daily loss' when leg > 6 then 'too many' else 'ok' end gate from p) select instance, gate, count(*) n from g group by 1, 2")
def gates(spark, d):
    x = M.equity(S.ledger(spark, d), ["instance"], ["exit_time", "trade_id", "leg"], 0.0, [F.to_date("exit_time")])
    gate = F.when(F.col("drawdown") > 20000, "drawdown").when(F.col("pnl") < -6000, "daily loss").when(F.col("leg") > 6, "too many").otherwise("ok")
    return x.withColumn("gate", gate).groupBy("instance", "gate").agg(F.count("*").alias("n"))


@query("t11_position_sizes", "select c_custkey, greatest(1, floor(c_acctbal * 0.01::double / 25 * 1000))::bigint units from customer where c_acctbal > 0")
def sizes(spark, d):
    c = S.read(spark, d, "customer").filter("c_acctbal > 0")
    return c.select("c_custkey", F.greatest(F.lit(1), F.floor(F.col("c_acctbal") * 0.01 / 25 * 1000)).cast("long").alias("units"))


@query("t11_quote_units", "with p as (select o_orderkey, o_totalprice, ['EUR_USD', 'USD_JPY', 'EUR_GBP', 'AUD_CAD'][1 + o_orderkey % 4] pair from orders) select o_orderkey, pair, floor(o_totalprice / 100 / case right(pair, 3) when 'JPY' then 0.0067::double when 'GBP' then 1.27 when 'CAD' then 0.74 else 1 end)::bigint units from p")
def quote_units(spark, d):
    pair = F.element_at(F.array(*map(F.lit, ("EUR_USD", "USD_JPY", "EUR_GBP", "AUD_CAD"))), (1 + F.col("o_orderkey") % 4).cast("int"))
    o = S.read(spark, d, "orders").withColumn("pair", pair)
    return o.select("o_orderkey", "pair", F.floor(F.col("o_totalprice") / 100 / P.quote_rate(F.col("pair"))).cast("long").alias("units"))


@query("t13_stale_heartbeats", "with h as (select user_id, max(ts) last_ts from events group by 1), n as (select max(ts) t from events) select user_id, case when epoch(t) - epoch(last_ts) > 86400 then 'DOWN' when epoch(t) - epoch(last_ts) > 21600 then 'LATE' else 'OK' end status from h, n")
def heartbeats(spark, d):
    h = S.read(spark, d, "events").groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("last"))
    now = h.agg(F.max("last").alias("now"))
    age = F.col("now").cast("double") - F.col("last").cast("double")
    return h.join(F.broadcast(now)).select("user_id", F.when(age > 86400, "DOWN").when(age > 21600, "LATE").otherwise("OK").alias("status"))  # now is one row


@query("session_gaps", "with x as (select user_id, ts, case when epoch(ts) - epoch(lag(ts) over (partition by user_id order by ts)) <= 7200 then 0 else 1 end fresh from events), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) k from x) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') start, count(*) n from s group by user_id, k")
def session_gaps(spark, d):
    """Runs of events at most 7200 s apart; Spark ends a session after its last gap, that very microsecond included."""
    e = S.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    x = e.groupBy("user_id", F.session_window("ts", "7200 seconds").alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first"))
    return x.select("user_id", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
