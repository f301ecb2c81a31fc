"""Trade-ledger metrics, equity curves and streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import scan

#: Bars of a year. Fixed values.
BARS_PER_YEAR = {"M1": 252 * 1440, "M5": 252 * 288, "M15": 252 * 96, "M30": 252 * 48, "H1": 252 * 22, "H4": 252 * 6, "D": 252}


def in_order(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def profit_factor(win: Column, loss: Column) -> Column:
    return F.when(loss > 0.01, F.try_divide(win, loss)).when(win > 0, 100.0).otherwise(0.0)


def equity(trades: DataFrame, keys: list[str], order: list[str], capital: float, block: list[Column | str] | None = None) -> DataFrame:
    """Adds n (from 1), equity, peak (the capital counts), drawdown and drawdown_pct; ``block`` is that of ``scans.scan``, by which a key is cut."""
    x = scan(trades, keys, order, block or [], sums={"_n": F.lit(1), "_gain": F.col("pnl")}, peaks={"_top": ("_gain", None)})
    x = x.withColumn("n", (F.col("_n_before") + 1).cast("int")).withColumn("equity", F.lit(capital) + (F.col("_gain_before") + F.col("pnl")))
    x = x.withColumn("peak", F.greatest(F.lit(capital), F.lit(capital) + F.col("_top_before"), "equity")).drop("_n_before", "_gain_before", "_top_before")
    return x.withColumn("drawdown", F.col("peak") - F.col("equity")).withColumn("drawdown_pct", F.try_divide(F.col("drawdown") * 100, F.col("peak")))


def summary(trades: DataFrame, keys: list[str], order: list[str], capital: float, bars: int, bars_per_year: int, block: list[Column | str] | None = None) -> DataFrame:
    """One row a key: counts, win rate, profit factor, Sharpe, Sortino, R², drawdown, ulcer, return, on-test score and quality."""
    x = equity(trades, keys, order, capital, block)
    a = x.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.count_if(F.col("pnl") > 0).alias("wins"), F.sum("pnl").alias("profit"),
        F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0)).alias("gross_win"), F.sum(F.when(F.col("pnl") <= 0, -F.col("pnl")).otherwise(0.0)).alias("gross_loss"),
        F.avg("pnl").alias("mean"), F.stddev_samp("pnl").alias("dev"), F.sqrt(F.avg(F.when(F.col("pnl") < 0, F.col("pnl") * F.col("pnl")).otherwise(0.0))).alias("down"),
        F.regr_r2("equity", "n").alias("r2"), F.max("drawdown_pct").alias("max_dd"), F.sqrt(F.avg(F.col("drawdown_pct") * F.col("drawdown_pct"))).alias("ulcer"),
    )
    year = F.sqrt(F.col("trades") * bars_per_year / F.lit(float(bars)))
    dev = F.when(F.col("trades") > 1, F.col("dev")).otherwise(1.0)
    a = a.withColumn("win_rate", F.col("wins") * 100 / F.col("trades")).withColumn("profit_factor", profit_factor(F.col("gross_win"), F.col("gross_loss")))
    a = a.withColumn("sharpe", F.when(dev > 0, year * F.col("mean") / dev).otherwise(0.0))
    a = a.withColumn("sortino", F.when(F.col("down") > 0, F.least(F.lit(20.0), year * F.try_divide(F.col("mean"), F.col("down")))).when(F.col("mean") > 0, 20.0).otherwise(0.0))
    a = a.withColumn("r_squared", F.when(F.col("trades") < 3, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("r2", F.lit(0.0))))))
    a = a.withColumn("total_return", F.col("profit") * 100 / capital)
    a = a.withColumn("ontester", F.when(F.col("profit") > 0, F.col("profit") * F.col("r_squared") * F.least("profit_factor", F.lit(10.0)) * F.sqrt("trades") / (F.col("max_dd") + 5)).otherwise(0.0))
    a = a.withColumn("quality", quality(*map(F.col, ("sortino", "r_squared", "profit_factor", "trades", "max_dd", "total_return", "ulcer"))))
    return a.select(*keys, "trades", "win_rate", "profit_factor", "sharpe", "sortino", "r_squared", "max_dd", "ulcer", "total_return", "ontester", "quality")


def ulcer_by_day(trades: DataFrame, keys: list[str], order: list[str], ts: str, capital: float, block: list[Column | str] | None = None) -> DataFrame:
    """Root of the mean square of the drawdown in percent at the close of every day from a key's first trade to its last; days without trades keep the last one."""
    x = equity(trades, keys, order, capital, block).withColumn("_day", F.to_date(ts))
    days = x.groupBy(*keys, "_day").agg(F.max_by("drawdown_pct", F.struct(*order)).alias("_dd"))
    held = F.coalesce(F.datediff(F.lead("_day").over(in_order(keys, ["_day"])), "_day"), F.lit(1))  # a row a day: bounded by the calendar
    return days.withColumn("_held", held).groupBy(*keys).agg(F.sqrt(F.sum(F.col("_dd") * F.col("_dd") * F.col("_held")) / F.sum("_held")).alias("ulcer"), F.sum("_held").alias("days"))


def quality(sortino: Column, r2: Column, pf: Column, trades: Column, max_dd: Column, total_return: Column, ulcer: Column) -> Column:
    """Smooth, profitable and shallow equity in one number; 0 if any factor isn't above 0."""
    value = F.least(sortino, F.lit(20.0)) * r2 * F.least(pf, F.lit(5.0)) * F.sqrt(F.least(trades, F.lit(200))) * (1 + F.least(F.greatest(total_return, F.lit(0.0)), F.lit(200.0)) / 100) / (ulcer + max_dd / 2 + 5)
    return F.when((trades < 1) | (sortino <= 0) | (pf <= 0) | (r2 <= 0), 0.0).otherwise(value)


def streaks(trades: DataFrame, keys: list[str], order: list[str], block: list[Column | str] | None = None) -> DataFrame:
    """Longest runs of wins and of losses of each key.

    Each block (see ``scans.scan``) is summed up in one row: for each side its number, those before the first and before the last other
    trade, and its longest run. A trade without a result ends both runs. Rows of blocks are summed up the same way, so the trades are shuffled and sorted once
    and nothing is joined back to them.
    """
    blocks = [f"_block{i}" for i in range(len(block or []))]
    win = F.col("pnl") > 0
    x = trades.select(*keys, *order, *[(F.expr(c) if isinstance(c, str) else c).alias(b) for b, c in zip(blocks, block or [])], win.alias("_win"))
    for side, mine in (("win", F.col("_win")), ("loss", ~F.col("_win"))):
        n = F.coalesce(mine.cast("long"), F.lit(0))
        x = x.withColumns({f"_{side}_n": n, f"_{side}_first": F.when(n == 0, n), f"_{side}_last": F.when(n == 0, n), f"_{side}_best": n})
    for level in range(len(blocks), -1, -1):
        by = [*keys, *blocks[:level]]
        before = Window.partitionBy(*by).orderBy(*(order if level == len(blocks) else [blocks[level]])).rowsBetween(Window.unboundedPreceding, -1)
        x = x.withColumns({f"_{s}_before": F.coalesce(F.sum(f"_{s}_n").over(before), F.lit(0)) for s in ("win", "loss")})
        x = x.withColumns({f"_{s}_at": F.max(F.col(f"_{s}_before") + F.col(f"_{s}_last")).over(before) for s in ("win", "loss")})
        totals = []
        for s in ("win", "loss"):
            had, run = F.col(f"_{s}_before"), F.col(f"_{s}_before") - F.coalesce(f"_{s}_at", F.lit(0))
            totals += [F.sum(f"_{s}_n").alias(f"_{s}_n"), F.min(had + F.col(f"_{s}_first")).alias(f"_{s}_first"), F.max(had + F.col(f"_{s}_last")).alias(f"_{s}_last")]
            totals.append(F.max(F.greatest(F.col(f"_{s}_best"), run + F.coalesce(f"_{s}_first", f"_{s}_n"))).alias(f"_{s}_best"))
        x = x.groupBy(*by).agg(*totals)
    return x.select(*keys, *[F.coalesce(f"_{s}_best", F.lit(0)).alias(f"{s}_streak") for s in ("win", "loss")])


def closing_losses(trades: DataFrame, keys: list[str], order: list[str], last: int = 20) -> DataFrame:
    """Losses in a row at the end of each key, among its last ``last`` trades, and whether that is three or more.

    Each task keeps the last trades it has of a key before any are shuffled, so a key costs as many rows as there are tasks.
    """
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    x = trades.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= last)
    still = F.min(F.when(F.col("pnl") < 0, 1).otherwise(0)).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("still", still).groupBy(*keys).agg(F.sum("still").alias("streak")).withColumn("alert", F.col("streak") >= 3)


def histogram(trades: DataFrame, bucket: Column, size: int) -> DataFrame:
    """Counts and profit of buckets 0 to size - 1, empty ones included."""
    have = trades.groupBy(bucket.cast("int").alias("bucket")).agg(F.count("*").alias("trades"), F.sum("pnl").alias("pnl"))
    every = trades.sparkSession.range(size).select(F.col("id").cast("int").alias("bucket"))
    return every.join(have, "bucket", "left").na.fill({"trades": 0, "pnl": 0.0})


def daily_balance(trades: DataFrame, keys: list[str], ts: str, capital: float) -> DataFrame:
    """Trades, profit and closing balance of each key's days, made anew from its trades."""
    days = trades.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.count("*").alias("n"), F.sum("pnl").alias("pnl"))
    return days.withColumn("balance", capital + F.sum("pnl").over(in_order(keys, ["day"]).rowsBetween(Window.unboundedPreceding, 0)))
