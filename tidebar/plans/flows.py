"""Queries of file sources and sinks, streams run to their end, fleet reports and the rest of the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import exits as E
from ..operators import indicators as I
from ..operators import metrics as M
from ..operators import signals as G
from ..operators import stages as T
from ..operators import validation as V
from ..operators.scans import place
from ..session import workdir
from ..sources import documents as D
from ..sources import pages as G_
from ..sources import tables as S
from ..streaming import candles as C
from ..streaming import replays as A
from ..streaming import state as R
from .market import _ATR, _R, STAMP, _donchian_sql, _rsi_sql
from .more import _HELD, _held
from .registry import query
from .research import _RES, _WIN, _results, _windows
from .trading import _EQ, _SUM, DAYS, ORDER

_B, _L = f"with {S.BARS_SQL}", f"with {S.LEDGER_SQL}"
_SIG = f"s as ({_donchian_sql(20)})"


def _written(df: DataFrame) -> DataFrame:
    """``df`` by way of the shared folder, for what reads it again and again."""
    folder = workdir(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


# --- files ----------------------------------------------------------------------------------


@query("s02_bars_sink", f"{_B} select sym, bar, close from bars")
def bars_sink(spark, d):
    folder = workdir(spark)
    D.write_bars(S.bars_h1(spark, d), folder)
    return spark.read.parquet(folder).select("sym", "bar", "close")


@query("s13_trade_lists", f"{_L} select trade_id, leg, pnl from ledger")
def trade_lists(spark, d):
    """Documents of one day of an instance each: a list, or an object with a list under one of two names."""
    t = S.ledger(spark, d).select("instance", F.to_date("exit_time").alias("day"), F.struct("trade_id", "leg", "pnl").alias("t"))
    lists = t.groupBy("instance", "day").agg(F.collect_list("t").alias("trades"))
    named = F.when(F.col("instance") % 3 == 1, F.to_json("trades")).when(F.col("instance") % 6 == 2, F.to_json(F.struct("trades"))).otherwise(F.to_json(F.struct(F.col("trades").alias("trade_history"))))
    docs = lists.select(named.alias("value"))
    return D.trades_of(docs, "value", "trade_id: long, leg: int, pnl: double").select("trade_id", "leg", "pnl")


@query("s14_json_lines", "select event_id, value from events where event_id % 10 <> 3")
def json_lines(spark, d):
    folder = workdir(spark)
    e = S.read(spark, d, "events")
    line = F.when(F.col("event_id") % 10 == 3, "{broken").otherwise(F.to_json(F.struct("event_id", "value")))
    e.filter("event_id % 10 < 5").select(line.alias("value")).write.text(folder)
    D.append_lines(e.filter("event_id % 10 >= 5").select("event_id", "value"), folder)
    return D.read_lines(spark, folder, "event_id long, value double")


@query("s16_broker_csv", "select event_id ticket, strftime(date_trunc('second', ts) + to_hours(12), '%Y-%m-%d %H:%M:%S') ts, event_type instrument from events")
def broker_csv(spark, d):
    folder = workdir(spark)
    raw = S.read(spark, d, "events").select(F.concat(F.lit(" "), F.col("event_id").cast("string")).alias("TICKET"), F.col("event_type").alias("INSTRUMENT"), F.concat(F.date_format(F.col("ts").cast("timestamp"), STAMP), F.lit(" -12")).alias("TRANSACTION DATE"))
    raw.write.option("header", True).csv(folder)
    return D.read_transactions(spark, folder).select(F.col("ticket").cast("long").alias("ticket"), F.date_format("ts", STAMP).alias("ts"), "instrument")


@query("s17_trade_export", f"{_L} select trade_id, exit_reason, pnl realized_pnl from ledger")
def trade_export(spark, d):
    folder = workdir(spark)
    D.write_trades(S.ledger(spark, d).withColumnRenamed("pnl", "realized_pnl"), folder)
    back = spark.read.option("header", True).csv(folder)
    return back.select(F.col("trade_id").cast("long").alias("trade_id"), "exit_reason", F.col("realized_pnl").cast("double").alias("realized_pnl"))


@query("s18_ranked_export", f"{_L}, t as (select instance, round(sum(pnl), 2) q from ledger group by 1) select instance, q, row_number() over (order by q desc, instance) as \"rank\" from t")
def ranked_export(spark, d):
    folder = workdir(spark)
    t = S.ledger(spark, d).groupBy("instance").agg(F.round(F.sum("pnl"), 2).alias("q"))
    V.ranked(t, "q", "instance", "rank").write.option("header", True).csv(folder)
    return spark.read.option("header", True).csv(folder).selectExpr("cast(instance as long) instance", "cast(q as double) q", "cast(rank as long) rank")


_STAGES = ("data", "optimization", "walkforward", "stability", "montecarlo", "confidence", "report")


def _states(spark: SparkSession, d: str) -> DataFrame:
    """State documents of runs, a supplier each: stage i is completed, failed or pending by the keys."""
    s = S.read(spark, d, "supplier").select("s_suppkey")
    stage = lambda i: F.struct(F.when(F.col("s_suppkey") % 9 > i, "completed").when((F.col("s_suppkey") % 9 == i) & (F.col("s_suppkey") % 2 == 0), "failed").otherwise("pending").alias("status"), (F.col("s_suppkey") % 50 + i).cast("double").alias("duration_seconds"))
    return s.select(F.col("s_suppkey").alias("run"), F.to_json(F.struct(F.struct(*[stage(i).alias(n) for i, n in enumerate(_STAGES)]).alias("stages"))).alias("value"))


_RUNS = "r as (select s_suppkey run, s_suppkey % 9 done, s_suppkey % 9 < 7 and s_suppkey % 2 = 0 failed, s_suppkey % 50 sec from supplier)"


@query("s20_run_directories", f"with {_RUNS} select run, case when done >= 1 then 'completed' when failed then 'failed' else 'pending' end data from r")
def run_directories(spark, d):
    folder = workdir(spark)
    D.write_runs(_states(spark, d), folder)  # a folder a run
    docs = D.read_runs(spark, folder, "stages struct<data: struct<status: string>>")
    return docs.select("run", F.col("doc.stages.data.status").alias("data"))


@query("q07_run_index", f"with {_RUNS} select run, least(done, 7)::bigint stages_done, case when failed then 'FAILED' when done >= 7 then 'COMPLETE' else 'PARTIAL' end status, round(case when failed then (done + 1) * sec + done * (done + 1) / 2 else 7 * sec + 21 end / 60, 4) as minutes from r")
def run_index(spark, d):
    docs = D.parsed(_states(spark, d), "value", "stages map<string, struct<status: string, duration_seconds: double>>")
    return D.run_index(docs, F.col("doc.stages"), list(_STAGES)).select("run", F.col("stages_done").cast("long").alias("stages_done"), "status", F.round("minutes", 4).alias("minutes"))


@query("s21_health_files", "select s_suppkey instance, case when s_suppkey % 5 = 0 then 'unreadable' when s_acctbal < 0 then 'error' else 'running' end status from supplier")
def health_files(spark, d):
    folder = workdir(spark)
    s = S.read(spark, d, "supplier")
    doc = F.when(F.col("s_suppkey") % 5 == 0, "{half").otherwise(F.to_json(F.struct(F.when(F.col("s_acctbal") < 0, "error").otherwise("running").alias("status"))))
    D.write_runs(s.select(F.col("s_suppkey").alias("run"), doc.alias("value")), folder)
    return D.read_runs(spark, folder, "status string").select(F.col("run").alias("instance"), F.coalesce("doc.status", F.lit("unreadable")).alias("status"))


def _candle_pages(spark: SparkSession, d: str) -> str:
    """Hourly candles as a service's pages of 200, each with the first candle of the next one and, at the very end, one that isn't complete."""
    folder = f"{workdir(spark)}/pages"
    bars = S.bars_h1(spark, d)
    last = bars.groupBy("sym").agg(F.max("bar").alias("_last"))
    number = lambda c: F.floor(c / 200)
    x = bars.join(last, "sym").withColumn("complete", F.col("bar") < F.col("_last")).withColumn("page", F.explode(F.array_distinct(F.array(number(F.col("bar")), F.greatest(number(F.col("bar") - 1), F.lit(0))))))
    G_.register(spark)
    G_.write_pages(x.select("sym", "ts", "open", "high", "low", "close", "volume", "complete", "page"), "sym", "ts", "page", folder)
    return folder


_PAGED = f"{_B}, l as (select sym, max(bar) z from bars group by 1), p as (select bars.*, strftime(ts, '%Y-%m-%d %H:%M:%S') at_ from bars join l on l.sym = bars.sym and bar < z)"


@query("s03_candle_pages", f"{_PAGED} select sym, at_ as ts, open, high, low, close, volume from p")
def candle_pages(spark, d):
    """Complete candles of all pages, each once."""
    rows = spark.read.format("pages").schema(G_.CANDLE).load(_candle_pages(spark, d))
    return G_.closed_once(rows, ["sym", "ts"], "volume").select("sym", F.date_format("ts", STAMP).alias("ts"), "open", "high", "low", "close", "volume")


@query("s04_paged_range", f"{_PAGED} select sym, at_ as ts, close from p where sym in ('click', 'purchase') and ts >= (select median(ts) from events)")
def paged_range(spark, d):
    """A range of times of two instruments: other pages aren't opened."""
    folder = _candle_pages(spark, d)
    middle = S.read(spark, d, "events").agg(F.median(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]  # the bound a user would type
    rows = spark.read.format("pages").schema(G_.CANDLE).load(folder).filter((F.col("ts") >= F.timestamp_micros(F.lit(int(middle)))) & F.col("sym").isin("click", "purchase"))
    return G_.closed_once(rows, ["sym", "ts"], "volume").select("sym", F.date_format("ts", STAMP).alias("ts"), "close")


@query("s05_transaction_pages", "select event_id id, event_type kind, user_id account, value amount from events")
def transaction_pages(spark, d):
    """Transactions by pages of 500 by id, a folder for each thousand accounts; pages overlap by one. So their number grows with the rows alone."""
    folder = f"{workdir(spark)}/pages"
    e = S.read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("user_id").alias("account"), F.col("value").alias("amount"), F.col("ts").cast("timestamp").alias("ts"))
    number = lambda c: F.floor(c / 500)
    e = place(e.withColumn("book", F.format_string("book%d", F.floor(F.col("account") / 1000))), ["book"], ["id"], [F.floor(F.col("id") / 100_000)], "n")
    first = F.col("n") - 1
    e = e.withColumn("page", F.explode(F.array_distinct(F.array(number(first), F.greatest(number(first - 1), F.lit(0)))))).drop("n")
    G_.register(spark)
    G_.write_pages(e, "book", "ts", "page", folder)
    rows = spark.read.format("pages").option("group", "book").option("pages", "64").schema("id long, kind string, account long, amount double, ts timestamp, book string").load(folder)
    return rows.dropDuplicates(["id"]).select("id", "kind", "account", "amount")


@query("s03_candle_stream", f"{_PAGED} select sym, at_ as ts, close from p")
def candle_stream(spark, d):
    """The same pages as a stream, page by page in the order they came."""
    rows = spark.readStream.format("pages").schema(G_.CANDLE).load(_candle_pages(spark, d))
    once = rows.filter("complete").withWatermark("ts", "10 days").dropDuplicates(["sym", "ts"])
    return _ran(once, available=False).select("sym", F.date_format("ts", STAMP).alias("ts"), "close")


# --- streams, run to their end --------------------------------------------------------------


def _ran(stream: DataFrame, available: bool = True) -> DataFrame:
    """What a stream writes until it has read all there is now; ``available``: whether its source knows that trigger."""
    folder = workdir(stream.sparkSession)
    out = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    if available:
        out = out.trigger(availableNow=True).start()
        out.awaitTermination()
    else:
        out = out.start()
        out.processAllAvailable()
        out.stop()
    if out.exception():
        raise out.exception()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


_CLOSED = "select sym, strftime(ts, '%Y-%m-%d %H:%M:%S') ts, open, high, low, close, volume from c where ts + interval {w} <= (select max(ts) - interval 2 second from ticks)"


@query("t01_t03_closed_candles", f"with {S.TICKS_SQL}, c as (select sym, time_bucket(interval 4 hour, ts) ts, first(price order by ts, seq) open, max(price) high, min(price) low, last(price order by ts, seq) as close, count(*) volume from ticks group by 1, 2) {_CLOSED.format(w='4 hour')}")
def closed(spark, d):
    return _ran(C.closed_candles(C.ticks(spark, f"{d}/events.parquet*"), "4 hours")).select("sym", F.date_format("ts", STAMP).alias("ts"), "open", "high", "low", "close", "volume")


@query("t02_tumbling_windows", f"with {S.TICKS_SQL}, c as (select sym, date_trunc('hour', ts) ts, first(price order by ts, seq) open, max(price) high, min(price) low, last(price order by ts, seq) as close, count(*) volume from ticks group by 1, 2) {_CLOSED.format(w='1 hour')}")
def tumbling(spark, d):
    return _ran(C.closed_candles(C.ticks(spark, f"{d}/events.parquet*"), "1 hour")).select("sym", F.date_format("ts", STAMP).alias("ts"), "open", "high", "low", "close", "volume")


@query("t04_replays", "select event_id seq, event_type sym, value price from events")
def replays(spark, d):
    """All ticks come once, some twice in a batch, and all of them again when everything is long closed."""
    folder = workdir(spark)
    e = S.read(spark, d, "events")
    e.unionAll(e.filter("event_id % 5 = 0")).repartitionByRange(3, "ts").write.parquet(f"{folder}/ticks")
    writer = lambda: A.archive_once(C.ticks(spark, f"{folder}/ticks", files_per_trigger=2), ["seq"], "ts", folder)
    R.run_rest(writer())
    e.repartitionByRange(2, "ts").write.mode("append").parquet(f"{folder}/ticks")
    R.run_rest(writer())
    return spark.read.parquet(f"{folder}/rows").select("seq", "sym", "price")


@query("t05_latest_bar", f"{_B}, {_SIG}, l as (select sym, max(bar) - 30 cut from bars group by 1) select s.sym, bar, direction from s join l on s.sym = l.sym where direction is not null and bar > cut")
def latest_bar(spark, d):
    bars = S.bars_h1(spark, d)
    return G.on_latest(bars, lambda x: G.donchian(x, 20), 30, 21).select("sym", "bar", "direction")


@query("t08_daily_statistics", "with x as (select cast(ts as date) dt, value - 250 pnl from events) select strftime(dt, '%Y-%m-%d') as \"day\", count(*) trades, count(*) filter (pnl > 0) wins, round(sum(pnl), 2) pnl from x where dt + interval 1 day <= (select max(ts) - interval 1 day from events) group by 1")
def daily(spark, d):
    trades = C.ticks(spark, f"{d}/events.parquet*").withColumn("pnl", F.col("price") - 250)
    return _ran(C.daily(trades)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "trades", "wins", F.round("pnl", 2).alias("pnl"))


@query("t09_broker_reconciliation", "select event_id seq, user_id from events where event_type = 'purchase' and user_id not in (select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY'))")
def reconciliation(spark, d):
    local = C.ticks(spark, f"{d}/events.parquet*", more=["user_id"]).filter("sym = 'purchase'")
    broker = S.read(spark, d, "customer").filter("c_mktsegment in ('BUILDING', 'MACHINERY')").select(F.col("c_custkey").alias("user_id"))
    return _ran(C.not_at_broker(local, broker, ["user_id"])).select("seq", "user_id")


@query("t12_occupied_pairs", "with o as (select o_custkey user_id, max(o_orderkey) k from orders where o_orderstatus = 'O' group by 1) select event_id seq, (k is not null) occupied from events left join o using (user_id)")
def occupied(spark, d):
    positions = S.read(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("user_id")).distinct()
    return _ran(C.marked_occupied(C.ticks(spark, f"{d}/events.parquet*", more=["user_id"]), positions, ["user_id"])).select("seq", "occupied")


# --- reports --------------------------------------------------------------------------------


@query("q01_equity_curve", f"{_L}, {_EQ} select instance, n, round(equity - 3000, 2) gain from eq")
def equity_curve(spark, d):
    return M.equity(S.ledger(spark, d), ["instance"], ORDER, 3000.0).select("instance", "n", F.round(F.col("equity") - 3000, 2).alias("gain"))


@query("q05_window_bars", f"with {S.LEDGER_SQL}, {_WIN}, r as (select w.sym, \"window\", count(pnl) n, coalesce(sum(pnl), 0) s from w left join ledger on pair = w.sym and exit_time >= test_start and exit_time < test_end group by 1, 2) select sym, \"window\", n, round(s, 2) total, s > 0 passed from r")
def window_bars(spark, d):
    w = _windows(spark, d)
    months = F.explode(F.sequence(F.trunc("test_start", "month"), F.trunc("test_end", "month"), F.expr("interval 1 month")))
    trades = S.ledger(spark, d).select(F.col("pair").alias("sym"), "exit_time", "pnl", F.trunc("exit_time", "month").alias("month"))
    hit = w.withColumn("month", months).join(trades, ["sym", "month"]).filter("exit_time >= test_start and exit_time < test_end")
    total = hit.groupBy("sym", "window").agg(F.count("pnl").alias("n"), F.sum("pnl").alias("s"))
    return w.join(total, ["sym", "window"], "left").select("sym", "window", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("total"), (F.coalesce("s", F.lit(0.0)) > 0).alias("passed"))


@query("q06_leaderboard", f"{_L}, {_EQ}, {_SUM} select instance, trades, round(pf, 4) profit_factor, round(ret, 3) total_return from s where trades >= 20 order by ret desc, instance limit 25")
def leaderboard(spark, d):
    s = M.summary(S.ledger(spark, d), ["instance"], ORDER, 3000.0, 2400, 252).filter("trades >= 20")
    return s.orderBy(F.desc("total_return"), "instance").limit(25).select("instance", "trades", F.round("profit_factor", 4).alias("profit_factor"), F.round("total_return", 3).alias("total_return"))


_HALVES = "hv as (select instance, count(*) filter (not f) bn, count(*) filter (f) fn, avg((pnl > 0)::int::double) filter (not f) bw, avg((pnl > 0)::int::double) filter (f) fw, sum(pnl) filter (not f) bs, sum(pnl) filter (f) fs, datediff('day', min(cast(exit_time as date)) filter (f), max(cast(exit_time as date)) filter (f)) fd from (select *, exit_time >= timestamp '1998-01-01' f from ledger) group by 1)"


def _halves(spark, d):
    x = S.ledger(spark, d).withColumn("f", F.col("exit_time") >= F.lit("1998-01-01").cast("timestamp"))
    part = lambda c, f: F.when(F.col("f") == f, c)
    won = (F.col("pnl") > 0).cast("double")
    sums = [F.count(part(F.lit(1), f)).alias(f"{n}n") for n, f in (("b", False), ("f", True))] + [F.avg(part(won, f)).alias(f"{n}w") for n, f in (("b", False), ("f", True))] + [F.sum(part(F.col("pnl"), f)).alias(f"{n}s") for n, f in (("b", False), ("f", True))]
    return x.groupBy("instance").agg(*sums, F.datediff(F.max(part(F.col("exit_time"), True)), F.min(part(F.col("exit_time"), True))).alias("fd"))


@query("q08_payloads", f"{_L}, {_HALVES} select instance, bn back_trades, fn forward_trades, round(bw, 4) back_win_rate, round(fw, 4) forward_win_rate, round(bs, 2) back_profit, round(fs, 2) forward_profit from hv")
def payloads(spark, d):
    x = _halves(spark, d).select("instance", F.struct(F.col("bn").alias("trades"), F.round("bw", 4).alias("win_rate"), F.round("bs", 2).alias("profit")).alias("back"), F.struct(F.col("fn").alias("trades"), F.round("fw", 4).alias("win_rate"), F.round("fs", 2).alias("profit")).alias("forward"))
    back = F.from_json(F.to_json("back"), "trades long, win_rate double, profit double")  # through the document and back
    x = x.withColumn("back", back)
    return x.select("instance", *[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in ("back", "forward") for c in ("trades", "win_rate", "profit")])


@query("q11_alerts", f"{_L}, {_HALVES} select instance, case when fn < 3 then 'few' when fn / (fd / 30.44::double) / (bn / 40.0::double) < 0.4 or fn / (fd / 30.44::double) / (bn / 40.0::double) > 1.1 then 'frequency' when fw < bw / 1.05::double then 'quality' else 'ok' end alert from hv")
def alerts(spark, d):
    x = _halves(spark, d)
    often = (F.col("fn") / (F.col("fd") / 30.44)) / (F.col("bn") / 40.0)
    return x.select("instance", F.when(F.col("fn") < 3, "few").when((often < 0.4) | (often > 1.1), "frequency").when(F.col("fw") < F.col("bw") / 1.05, "quality").otherwise("ok").alias("alert"))


@query("q17_repaired_days", f"{_L}, x as (select instance, cast(exit_time as date) dt, case when pnl < 0 then 0 else pnl end p from ledger), t as (select instance, dt, sum(p) pnl, count(*) n from x group by 1, 2) select instance, strftime(dt, '%Y-%m-%d') as \"day\", n, round(pnl, 2) pnl, round(3000 + sum(pnl) over (partition by instance order by dt), 2) balance from t")
def repaired(spark, d):
    x = S.ledger(spark, d).withColumn("pnl", F.when(F.col("pnl") < 0, 0.0).otherwise(F.col("pnl")))
    return M.daily_balance(x, ["instance"], "exit_time", 3000.0).select("instance", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", F.round("pnl", 2).alias("pnl"), F.round("balance", 2).alias("balance"))


@query("q18_expectations", f"{_L}, {_HALVES} select instance, round(fw, 4) win_rate, round(fn / greatest(fd / 30.44::double, 1), 1) trades_per_month, round(fs / 30, 2) forward_return_pct, fn forward_trades from hv")
def expectations(spark, d):
    return _halves(spark, d).select("instance", F.round("fw", 4).alias("win_rate"), F.round(F.col("fn") / F.greatest(F.col("fd") / 30.44, F.lit(1.0)), 1).alias("trades_per_month"), F.round(F.col("fs") / 30, 2).alias("forward_return_pct"), F.col("fn").alias("forward_trades"))


# --- the rest -------------------------------------------------------------------------------


@query("v03_out_of_sample", f"with {_WIN} select sym, \"window\", test_start >= date '1998-01-01' oos from w")
def out_of_sample(spark, d):
    return _windows(spark, d).select("sym", "window", (F.col("test_start") >= F.lit("1998-01-01").cast("date")).alias("oos"))


@query("v14_trade_details", f"{_L}, x as (select *, row_number() over (partition by instance order by exit_time, trade_id, leg) n, datediff('day', cast(entry_time as date), cast(exit_time as date)) held from ledger) select instance, count(*) trades, round(avg(held), 4) mean_held, round(max(pnl), 2) best, round(min(pnl), 2) worst, round(avg(case when pnl > 0 then pnl end), 3) mean_win, round(avg(case when pnl <= 0 then pnl end), 3) mean_loss, min(n) filter (pnl > 0) first_win from x group by 1")
def trade_details(spark, d):
    x = place(S.ledger(spark, d), ["instance"], ORDER, DAYS, "n").withColumn("n", F.col("n").cast("long")).withColumn("held", F.datediff("exit_time", "entry_time"))
    side = lambda won: F.round(F.avg(F.when(F.col("pnl") > 0, None if not won else F.col("pnl")).otherwise(None if won else F.col("pnl"))), 3)
    return x.groupBy("instance").agg(F.count("*").alias("trades"), F.round(F.avg("held"), 4).alias("mean_held"), F.round(F.max("pnl"), 2).alias("best"), F.round(F.min("pnl"), 2).alias("worst"), side(True).alias("mean_win"), side(False).alias("mean_loss"), F.min(F.when(F.col("pnl") > 0, F.col("n"))).alias("first_win"))


@query("x11_signature_best", f"{_RES}, k as (select trial, trial % 5 a, trial % 3 b, row_number() over (partition by trial % 5, trial % 3 order by back desc, trial) k from res) select trial, a, b from k where k <= 2")
def signature_best(spark, d):
    x = _results(spark, d).withColumn("a", F.col("trial") % 5).withColumn("b", F.col("trial") % 3)
    w = Window.partitionBy("a", "b").orderBy(F.desc("back"), "trial")
    return x.withColumn("k", F.row_number().over(w)).filter("k <= 2").select("trial", "a", "b")


@query("x12_grid_neighbours", "with p as (select p_partkey, 1 + p_size % 7 pos from part), l as (select [5, 10, 15, 20, 30, 40, 50] vs) select p_partkey, vs[pos] v, sg \"step\", vs[pos + sg] moved from p, l, (values (-1), (1)) g(sg) where pos + sg between 1 and 7")
def grid_neighbours(spark, d):
    values = [5, 10, 15, 20, 30, 40, 50]
    p = S.read(spark, d, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, values)), (1 + F.col("p_size") % 7).cast("int")).alias("v"))
    return V.grid_neighbours(p, "v", values).select("p_partkey", "v", "step", "moved")


@query("l02_decision_features", f"""{_HELD}, ra as ({_R}, {_ATR} select sym, bar, y atr from walk), rs as ({_rsi_sql('50', 9)}),
k as (select b.sym, b.bar, b.ts, b.close, atr, b.close - lag(b.close, 5) over w s5, b.close - lag(b.close, 20) over w s20, rsi - lag(rsi, 3) over w m3, rsi - lag(rsi, 10) over w m10
  from bars b left join ra on ra.sym = b.sym and ra.bar = b.bar left join rs on rs.sym = b.sym and rs.bar = b.bar window w as (partition by b.sym order by b.bar))
select h.sym, h.bar, at_ as at, h.direction, at_ - h.bar age, round(r, 4) r_now, round(mfe, 4) mfe, round(mae, 4) mae, round(greatest(0, mfe - r), 4) given_back, round(least(1, (at_ - h.bar) / 48.0::double), 4) age_share,
  round(abs(k.close - sl) / abs(price - sl), 4) to_stop, round(abs(tp - k.close) / abs(price - sl), 4) to_target, round(k.atr / n.atr, 4) range_ratio, round(greatest(-3, least(3, k.s5 / k.atr)), 4) slope_short, round(greatest(-3, least(3, k.s20 / k.atr)), 4) slope_long,
  round(greatest(-1, least(1, k.m3 / 20)), 4) momentum_short, round(greatest(-1, least(1, k.m10 / 20)), 4) momentum_long, hour(k.ts)::int "hour", (isodow(k.ts) - 1)::int weekday
from held h join o on o.sym = h.sym and o.bar = h.bar join k on k.sym = h.sym and k.bar = h.at_ join k n on n.sym = h.sym and n.bar = h.bar""")
def decision_features(spark, d):
    bars, held = _held(spark, d)
    x = E.market_features(E.decision_features(held, 48), bars)
    return x.select("sym", "bar", "at", "direction", "age", *[F.round(c, 4).alias(c) for c in (*_NUMBERS[1:], *_MARKET)], "hour", "weekday")


_MARKET = ["to_stop", "to_target", "range_ratio", "slope_short", "slope_long", "momentum_short", "momentum_long"]


@query("l07_confidence", "with t as (select o_orderkey, (o_orderkey % 97) / 97.0::double risk, (o_orderkey % 53) / 10.0::double hold from orders), n as (select min(hold) lo, max(hold) hi from t) select o_orderkey, round(0.5 * risk + 0.5 * (1 - (hold - lo) / (hi - lo)), 4) confidence from t, n")
def prediction_confidence(spark, d):
    t = S.read(spark, d, "orders").select("o_orderkey", ((F.col("o_orderkey") % 97) / 97.0).alias("risk"), ((F.col("o_orderkey") % 53) / 10.0).alias("hold"))
    return E.confidence(t, "risk", "hold").select("o_orderkey", F.round("confidence", 4).alias("confidence"))


_NUMBERS = ["age", "r_now", "mfe", "mae", "given_back", "age_share"]


@query("l06_exit_models")
def exit_models(spark, d):
    """A regressor of what holding on still brings and a classifier of whether it loses, on held bars; predictions for each."""
    x = E.decision_features(E.labels(_held(spark, d)[1]), 48).withColumn("loses", (F.col("remaining_r") < 0).cast("double")).fillna(0.0, ["remaining_r", "loses"])
    x = _written(x.withColumns({c: F.col(c).cast("double") for c in _NUMBERS}).fillna(0.0, _NUMBERS))
    if x.isEmpty():  # nothing was held, so there is nothing to learn or to predict
        return x.select("sym", "bar", "at", F.lit(0.0).alias("hold"), F.lit(0.0).alias("risk"))
    hold = E.trained(x, _NUMBERS, "remaining_r", "regressor").transform(x).withColumnRenamed("prediction", "hold").drop("_x")
    risk = E.trained(x, _NUMBERS, "loses").transform(hold) if x.select("loses").distinct().count() > 1 else hold.withColumn("prediction", F.lit(0.0))
    return risk.select("sym", "bar", "at", F.round("hold", 4).alias("hold"), F.col("prediction").alias("risk"))


@query("l10_signal_model")
def signal_model(spark, d):
    """Signals of the last fifth of bars, kept by a model of earlier ones if it tells winners apart (area 0.55 or more), else all."""
    bars = S.bars_h1(spark, d)
    names = ["atr_norm", "vol_regime", "trend_short", "trend_long", "rsi", "rsi_3", "rsi_10", "body", "from_top", "from_bottom"]
    future = F.lead("close", 10).over(Window.partitionBy("sym").orderBy("bar"))
    ahead = B.in_blocks(bars, 0, lambda x: x.select("sym", "bar", future.alias("later")), after=10)
    x = G.donchian(bars, 20).join(I.signal_features(bars).select("sym", "bar", *names), ["sym", "bar"]).join(ahead, ["sym", "bar"]).filter("later is not null")
    x = _written(x.withColumn("won", (F.col("direction") * (F.col("later") - F.col("price")) > 0).cast("double")).fillna(0.0, names))
    cut = x.agg(F.percentile_approx("bar", 0.8)).first()[0]
    early, late = x.filter(F.col("bar") < cut), x.filter(F.col("bar") >= cut)
    if early.select("won").distinct().count() < 2:
        return late.select("sym", "bar", "direction", F.lit(False).alias("filtered"))
    scored = E.trained(early, names, "won").transform(late)
    able = E.skill(scored, "rawPrediction", "won") >= 0.55
    return (scored.filter("prediction = 1") if able else scored).select("sym", "bar", "direction", F.lit(able).alias("filtered"))


# --- state and stages that resume ---


@query("t07_restored_state", "select event_type sym, count(*) n, round(sum(value), 4) total, max(value) top from events group by 1")
def restored_state(spark, d):
    """What a stream remembers that was stopped after two of twelve files and went on from its checkpoint."""
    folder = workdir(spark)
    # one file a batch, in time: rows are ranged, so no task writes them all
    S.read(spark, d, "events").repartitionByRange(12, "ts", "event_id").write.parquet(f"{folder}/ticks")
    made = lambda: R.totals(C.ticks(spark, f"{folder}/ticks", files_per_trigger=1)).writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{folder}/checkpoint")
    R.run_some(made(), 2)
    R.run_rest(made())
    x = R.state_table(spark, f"{folder}/checkpoint")
    return x.select("key.sym", F.col("value.count").alias("n"), F.round("value.sum", 4).alias("total"), F.col("value.max").alias("top"))


def _research_stages() -> list[T.Stage]:
    def data(line, orders):
        j = line.join(orders, line["l_orderkey"] == orders["o_orderkey"])
        return j.select(F.col("l_suppkey").alias("instance"), F.col("o_orderdate").alias("day"), (F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))).alias("pnl"))

    def candidates(data):
        return data.groupBy("instance").agg(F.count("*").alias("n"), F.sum("pnl").alias("profit")).filter("profit > 0")

    def windows(data, candidates):
        x = data.join(candidates.select("instance"), "instance", "left_semi")
        return x.groupBy("instance", F.year("day").alias("year")).agg(F.sum("pnl").alias("pnl"))

    def report(candidates, windows):
        good = windows.groupBy("instance").agg(F.count_if(F.col("pnl") > 0).alias("good"), F.count("*").alias("n_years"))
        return candidates.join(good, "instance")

    some = lambda: F.count("*") > 0
    return [T.Stage("data", ["lineitem", "orders"], data, some), T.Stage("candidates", ["data"], candidates, some), T.Stage("windows", ["data", "candidates"], windows), T.Stage("report", ["candidates", "windows"], report)]


_STAGED = """d as (select l_suppkey instance, o_orderdate dt, l_extendedprice * (l_discount - l_tax) pnl from lineitem join orders on l_orderkey = o_orderkey),
c as (select instance, count(*) n, sum(pnl) profit from d group by 1 having sum(pnl) > 0),
w as (select instance, year(dt) y, sum(pnl) pnl from d where instance in (select instance from c) group by 1, 2)"""


@query("v16_resumed_report", f"with {_STAGED}, g as (select instance, count(*) filter (pnl > 0) good, count(*) n_years from w group by 1) select c.instance, n, round(profit, 2) profit, good, n_years from c join g on g.instance = c.instance")
def resumed_report(spark, d):
    """The report of a second run, which finds all stages done by a first one that stopped after two."""
    folder, tables, stages = workdir(spark), {t: f"{d}/{t}.parquet" for t in ("lineitem", "orders")}, _research_stages()
    T.run(spark, folder, tables, stages[:2])
    x = T.run(spark, folder, tables, stages)["report"]
    return x.select("instance", "n", F.round("profit", 2).alias("profit"), "good", "n_years")


@query("v15_v16_stage_manifest", f"""with {_STAGED}, s as (select 'data' stage, (select count(*) from d) rows union all select 'candidates', (select count(*) from c) union all select 'windows', (select count(*) from w) union all select 'report', (select count(*) from c)),
r as (select stage, 1 run, 'ran' status, rows from s where stage in ('data', 'candidates') union all select stage, 2, case when stage in ('data', 'candidates') then 'skipped' else 'ran' end, rows from s)
select stage, run::bigint run, status, rows from r""")
def stage_manifest(spark, d):
    """What two runs did: the second skips what the first had finished."""
    folder, tables, stages = workdir(spark), {t: f"{d}/{t}.parquet" for t in ("lineitem", "orders")}, _research_stages()
    T.run(spark, folder, tables, stages[:2])
    T.run(spark, folder, tables, stages)
    return T.manifest(spark, folder).select("stage", "run", "status", "rows")
