"""Market tables derived from the star schema: ticks, bars, daily bars, a trade ledger, a fleet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sym, ts, seq, price: one row an event."""
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("sym"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"))


def bars_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly candles of the ticks, numbered from 0 for each instrument."""
    return B.numbered(B.candles(ticks(spark, sf_dir), "1 hour"))


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily candles of order prices, an instrument for each order priority."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("sym"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"))
    return B.numbered(B.candles(orders, "1 day"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades: a line item is a trade of its supplier's instance, from order date to ship date."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate", (F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))).alias("pnl"))
    order = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    return line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_suppkey").alias("instance"), F.col("o_orderpriority").alias("pair"), F.col("l_orderkey").alias("trade_id"), F.col("l_linenumber").alias("leg"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(-1).alias("direction"), F.col("l_returnflag").alias("exit_reason"),
        F.col("o_orderdate").cast("timestamp").alias("entry_time"), F.col("l_shipdate").cast("timestamp").alias("exit_time"), (F.floor(F.col("pnl") * 100 + 0.5) / 100).alias("pnl"),
    )


def total(pnl: str | Column = "pnl") -> Column:
    """Sum of a ledger's amounts, which are whole cents, by adding cents: the same number however rows are split, so equal sums tie."""
    return F.sum(F.rint((F.col(pnl) if isinstance(pnl, str) else pnl) * 100).cast("long")) / 100


def mean(pnl: str | Column = "pnl") -> Column:
    """Mean of such amounts; null without any."""
    return F.try_divide(total(pnl), F.count(pnl))


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry of instances: suppliers with nation and region; both dimensions have a fixed few rows."""
    supplier, nation, region = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    named = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return named.select(F.col("s_suppkey").alias("instance"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


#: The same tables for DuckDB, as common table expressions.
TICKS_SQL = "ticks as (select event_type sym, ts, event_id seq, value price from events)"
BARS_SQL = TICKS_SQL + """,
hours as (select sym, date_trunc('hour', ts) ts, first(price order by ts, seq) open, max(price) high, min(price) low, last(price order by ts, seq) as close, count(*) volume from ticks group by 1, 2),
bars as (select *, (row_number() over (partition by sym order by ts) - 1)::int bar from hours)"""
DAILY_SQL = """days as (select o_orderpriority sym, date_trunc('day', o_orderdate) ts, first(o_totalprice order by o_orderdate, o_orderkey) open, max(o_totalprice) high, min(o_totalprice) low, last(o_totalprice order by o_orderdate, o_orderkey) as close, count(*) volume from orders group by 1, 2),
bars as (select *, (row_number() over (partition by sym order by ts) - 1)::int bar from days)"""
LEDGER_SQL = """ledger as (select l_suppkey instance, o_orderpriority pair, l_orderkey trade_id, l_linenumber leg, case when l_linestatus = 'O' then 1 else -1 end direction, l_returnflag exit_reason,
  o_orderdate entry_time, l_shipdate exit_time, floor(l_extendedprice * (l_discount - l_tax) * 100 + 0.5) / 100 pnl from lineitem join orders on l_orderkey = o_orderkey)"""
FLEET_SQL = "fleet as (select s_suppkey instance, s_name as name, s_acctbal balance, n_name nation, r_name region from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"
