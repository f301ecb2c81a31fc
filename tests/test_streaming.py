"""Streams give what batches give."""

import pytest
from pyspark.sql import functions as F

from tidebar.operators import bars as B
from tidebar.sources import documents as D
from tidebar.sources import tables as S
from tidebar.streaming import candles as C


def run(df, spark, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_closed_candles(spark, data, tmp_path):
    src = tmp_path / "in"
    spark.read.parquet(f"{data}/events.parquet").coalesce(1).write.parquet(str(src))
    out = run(C.closed_candles(C.ticks(spark, str(src)), "1 hour"), spark, tmp_path, "candles_t")
    want = {(r.sym, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in B.candles(S.ticks(spark, data), "1 hour").collect()}
    got = {(r.sym, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in out.collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) <= 5


def test_without_repeats(spark, data, tmp_path):
    src = tmp_path / "in"
    e = spark.read.parquet(f"{data}/events.parquet")
    e.unionAll(e).coalesce(1).write.parquet(str(src))
    out = run(C.without_repeats(C.ticks(spark, str(src)), ["seq"]), spark, tmp_path, "once_t")
    assert out.count() == e.count()


def test_days_are_merged_once(spark, tmp_path):
    days = spark.createDataFrame([("2024-01-01", 3), ("2024-01-02", 5)], "day string, trades int").withColumn("day", F.to_date("day"))
    C.merge_days(days, str(tmp_path / "days"))
    C.merge_days(days.filter("trades = 5").withColumn("trades", F.lit(6)), str(tmp_path / "days"))
    assert sorted((str(r.day), r.trades) for r in spark.read.parquet(str(tmp_path / "days")).collect()) == [("2024-01-01", 3), ("2024-01-02", 6)]


def test_managed_positions(spark, tmp_path):
    rows = [(1, f"2024-01-01 0{h}:00:00", 1, 100.0, 98.0, hi, lo) for h, (hi, lo) in enumerate([(100.0, 100.0), (102.0, 99.0), (103.0, 101.0), (103.0, 100.0)])]
    src = tmp_path / "in"
    spark.createDataFrame(rows, "trade_id long, t string, direction int, price double, sl double, high double, low double").selectExpr("trade_id", "to_timestamp(t) ts", "direction", "price", "sl", "high", "low").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(spark.read.parquet(str(src)).schema).parquet(str(src))
    out = run(C.managed(stream, 1.5, 0.2, 2.5, 1.0, 50), spark, tmp_path, "managed_t")
    assert [(r.bar_number, r.action, round(r.new_sl, 2)) for r in out.orderBy("bar_number").collect()] == [(1, "breakeven", 100.2), (2, "trail", 102.0), (3, "stop", 102.0)]


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"trade_id": 1, "realized_pnl": 2.5}]')
    (tmp_path / "b.json").write_text('{"trades": [{"trade_id": 2, "realized_pnl": -1}]}')
    got = D.read_trades(spark, str(tmp_path), "trade_id: long, realized_pnl: double")
    assert sorted(map(tuple, got.collect())) == [(1, 2.5), (2, -1.0)]
    (tmp_path / "h").mkdir()
    (tmp_path / "h/c.json").write_text('{"trade_history": [{"trade_id": 3, "realized_pnl": 1}, {"trade_id": 4, "realized_pnl": 2}, {"trade_id": 5, "realized_pnl": 3}]}')
    assert sorted(r.trade_id for r in D.read_trades(spark, str(tmp_path / "h"), "trade_id: long, realized_pnl: double", last=2).collect()) == [4, 5]
    (tmp_path / "x").mkdir()
    (tmp_path / "x/t.csv").write_text("TICKET,TRANSACTION DATE\n 7 ,2026-02-17 13:00:13 -12\n")
    r = D.read_transactions(spark, str(tmp_path / "x")).first()
    assert r.ticket == "7" and str(r.ts) == "2026-02-18 01:00:13"
    D.write_trades(got.withColumn("extra", F.lit(1)), str(tmp_path / "out"))
    assert tuple(spark.read.option("header", True).csv(str(tmp_path / "out")).columns) == D.TRADE_COLUMNS


def test_bars_by_instrument(spark, data, tmp_path):
    bars = S.bars_h1(spark, data)
    D.write_bars(bars, str(tmp_path / "bars"))
    assert spark.read.parquet(str(tmp_path / "bars")).count() == bars.count()


def test_blocks_with_halo(spark, data, monkeypatch):
    from tidebar.operators import indicators as I
    from tidebar.operators import signals as G

    key = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())
    bars = S.bars_h1(spark, data)
    plans = {
        "ema": lambda: I.ema(bars, "close", 5, "y").select("sym", "bar", F.coalesce("y", F.lit(0.0))), "rsi": lambda: I.rsi(bars, 3, "y").select("sym", "bar", "y"),
        "donchian": lambda: G.donchian_variants(bars, [5, 10]).select("sym", "bar", "direction", "channel_period"), "divergence": lambda: G.divergence(bars).select("sym", "bar", "direction", "bars_between"),
    }
    one = {k: key(f()) for k, f in plans.items()}
    assert one["ema"] and one["donchian"] and one["divergence"]
    monkeypatch.setattr(B, "BLOCK", 37)
    assert {k: key(f()) for k, f in plans.items()} == one


def test_first_exits_climb_the_pyramid(spark, data):
    from tidebar.operators import simulate as X

    bars = S.bars_h1(spark, data).filter("bar < 120")
    s = bars.filter("bar % 7 = 0").select("sym", "bar", F.lit(1).alias("direction"), F.lit(0).alias("seq"), F.col("close").alias("price"), (F.col("close") - F.pmod(F.col("bar") * 37, F.lit(450))).alias("sl"), (F.col("close") + F.pmod(F.col("bar") * 53, F.lit(450))).alias("tp"), (F.col("bar") % 3 * 40).alias("max_bars"))
    key = lambda **kw: sorted(map(tuple, X.first_exits(s, bars, **kw).select("sym", "bar", "exit_bar", "reason", "exit_price").collect()))
    assert key(horizon=1000) == key(horizon=3, fan=2) == key(horizon=2, fan=3)


@pytest.mark.parametrize("months,years,want", [(12, 4, 0.75), (30, 4, 0.5), (1, 10, 0.9)])
def test_holdout(months, years, want):
    assert B.holdout_ratio(months, years) == pytest.approx(want)
