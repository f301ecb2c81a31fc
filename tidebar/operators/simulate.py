"""Trade simulation: single positions relationally, managed and grid positions by a kernel for each instrument and trial.

Relational form: exits don't depend on equity, so every signal meets the bars after it, block by
block, and takes its first exit; overlapping trades are thinned out by the order of bars; equity
compounds as a running sum of logarithms. The kernel handles daily limits, grids and partial
exits, which need the state of the account.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shares that the trials of an instrument are dealt into.
PARTS = 16
#: Names of the exit codes. Fixed values.
EXITS = ("sl", "tp", "trailing", "time", "stale", "ml", "force_close")


def first_exits(signals: DataFrame, bars: DataFrame, horizon: int = 256, fan: int = 16) -> DataFrame:
    """Exit bar, price and reason of each signal (sym, bar, direction, price, sl, tp, max_bars) by stop, target, time or end of data.

    The stop wins over the target in one bar; the time exit, at the close, comes before both. The
    bars of a signal's own block are searched one by one. Beyond, blocks of ``horizon`` bars stand
    in a pyramid of extremes, ``fan`` of a level to one of the next: a signal meets at most ``fan``
    of each level on its way up, takes the earliest that touches and goes down to its first block.
    So the join has some dozens of rows a signal, however long it lives.
    """
    b = bars.select("sym", F.col("bar").alias("at"), "high", "low", "close", F.floor(F.col("bar") / horizon).cast("int").alias("block"))
    greatest = bars.agg(F.max("bar")).first()[0] or 0
    levels = 1
    while horizon * fan**levels <= greatest:
        levels += 1
    row = lambda level: F.struct(F.lit(level).alias("level"), F.floor(F.col("block") / fan**level).cast("int").alias("node"))
    lowest = b.groupBy("sym", "block").agg(F.max("high").alias("top"), F.min("low").alias("bottom"), F.max("at").alias("last"))
    nodes = lowest.withColumn("n", F.explode(F.array(*map(row, range(levels))))).groupBy("sym", "n.level", "n.node").agg(F.max("top").alias("top"), F.min("bottom").alias("bottom"), F.max("last").alias("last"))
    s = signals.withColumn("id", F.struct("sym", "bar", "direction", "seq"))
    life = F.col("bar") + F.when(F.col("max_bars") > 0, F.col("max_bars")).otherwise(1 << 30)
    own = F.floor(F.col("bar") / horizon).cast("int")
    touches = F.when(F.col("direction") == 1, (F.col("bottom") <= F.col("sl")) | (F.col("top") >= F.col("tp"))).otherwise((F.col("top") >= F.col("sl")) | (F.col("bottom") <= F.col("tp")))
    timed = lambda size: (life >= F.col("node") * size * horizon) & (life <= F.col("last"))

    def met(asked: DataFrame, size: Column) -> DataFrame:
        """The first of the nodes (level, node) that each signal asks for which it leaves in."""
        found = asked.join(nodes, ["sym", "level", "node"]).filter(touches | timed(size))
        return found.groupBy("id").agg(F.min(F.struct((F.col("node") * size).alias("block"), "level", "node")).alias("f"))

    start, way = own + 1, []
    for level in range(levels):
        end = (F.floor(start / fan) * fan + fan - 1).cast("int")
        way.append(F.arrays_zip(F.array_repeat(F.lit(level), end - start + 1).alias("level"), F.sequence(start, end).alias("node")))
        start = (F.floor(start / fan) + 1).cast("int")
    spans = F.element_at(F.array(*[F.lit(fan**level) for level in range(levels)]), F.col("level") + 1)
    first = met(s.withColumn("n", F.explode(F.concat(*way))).select(*s.columns, "n.level", "n.node"), spans).select("id", "f.level", "f.node")
    for level in range(levels - 1, 0, -1):
        children = F.sequence(F.col("node") * fan, F.col("node") * fan + fan - 1)
        below = first.filter(F.col("level") == level).select("id", F.explode(children).alias("node")).withColumn("level", F.lit(level - 1))
        down = met(below.join(s, "id"), F.lit(fan ** (level - 1))).select("id", "f.level", "f.node")
        first = first.filter(F.col("level") < level).unionByName(down)
    near = first.select("id", F.col("node").alias("block")).join(s, "id").select(*s.columns, "block").unionByName(s.withColumn("block", own))
    hit = near.join(b, ["sym", "block"]).filter((F.col("at") > F.col("bar")) & (F.col("at") <= life))
    stop = F.when(F.col("direction") == 1, F.col("low") <= F.col("sl")).otherwise(F.col("high") >= F.col("sl"))
    goal = F.when(F.col("direction") == 1, F.col("high") >= F.col("tp")).otherwise(F.col("low") <= F.col("tp"))
    reason = F.when(F.col("at") == life, 3).when(stop, 0).when(goal, 1)
    hit = hit.withColumn("reason", reason).filter("reason is not null")
    done = hit.groupBy("id").agg(F.min(F.struct("at", "reason", "close")).alias("exit"))
    last = bars.groupBy("sym").agg(F.max("bar").alias("end"), F.max_by("close", "bar").alias("end_close"))
    out = s.join(done, "id", "left").join(last, "sym")
    price = F.when(F.col("exit.reason") == 0, F.col("sl")).when(F.col("exit.reason") == 1, F.col("tp")).when(F.col("exit.reason") == 3, F.col("exit.close")).otherwise(F.col("end_close"))
    return out.select(*signals.columns, F.coalesce("exit.at", "end").alias("exit_bar"), price.alias("exit_price"), F.coalesce("exit.reason", F.lit(6)).alias("reason"))


def _kernel(pdf: pd.DataFrame, bars: pd.DataFrame, capital: float, risk: float, slots: int, daily_trades: int, daily_loss: float, spread: float, slippage: float) -> Iterator[tuple]:
    """Bar by bar: exits (time, stale, stop, target), then stop moves for the next bar, then entries."""
    s = pdf.sort_values(["bar", "seq"], kind="stable").to_dict("records")
    high, low, close, at, day = (bars[c].to_numpy() for c in ("high", "low", "close", "bar", "day"))
    index = {int(b): i for i, b in enumerate(at)}
    waiting = [x for x in s if int(x["bar"]) in index]
    equity, k, held, today, n_today, start = capital, 0, [], None, 0, capital
    for i in range(index.get(int(waiting[0]["bar"]), 0) if waiting else len(at), len(at)):
        if day[i] != today:
            today, n_today, start = day[i], 0, equity
        keep = []
        for t in held:
            x, d = t["x"], t["x"]["direction"]
            age = i - t["i"]
            best, worst = (high[i], low[i]) if d == 1 else (low[i], high[i])
            t["mfe"], t["mae"] = max(t["mfe"], d * (best - x["price"])), max(t["mae"], d * (x["price"] - worst))
            out = None
            if 0 < x["max_bars"] <= age:
                out = (close[i], 3)
            elif 0 < x["stale_bars"] <= age and abs(close[i] - x["price"]) < x["atr"] / 2:
                out = (close[i], 4)
            elif d * worst <= d * t["sl"]:
                out = (t["sl"] - d * slippage, 2 if t["trailing"] else 0)
            elif d * best >= d * x["tp"]:
                out = (x["tp"], 1)
            if out is None:
                move = d * (best - x["price"])
                t["far"] = max(t["far"], move)
                level = t["sl"]
                if x["be_trigger"] > 0 and t["far"] >= x["be_trigger"]:
                    level = d * max(d * level, d * (x["price"] + d * min(x["be_offset"], x["be_trigger"])))
                if x["trail_mode"] == 1 and x["trail_start"] > 0:
                    trail = x["price"] + d * (t["far"] - x["chandelier_mult"] * x["atr"])
                elif x["trail_start"] > 0 and t["far"] >= x["trail_start"]:
                    trail = x["price"] + d * (t["far"] - min(x["trail_step"], x["trail_start"]))
                else:
                    trail = None
                if trail is not None and d * trail > d * level:
                    level, t["trailing"] = trail, True
                t["sl"] = level
                if x["partial_pct"] > 0 and not t["partial"] and move >= x["partial_target"] > 0:
                    part = t["size"] * x["partial_pct"]
                    t["partial"], t["pnl"], t["size"] = True, part * (x["partial_target"] - spread), t["size"] - part
                keep.append(t)
                continue
            pnl = t["pnl"] + t["size"] * (d * (out[0] - x["price"]) - spread)
            equity += pnl
            yield t, int(at[i]), out[0], out[1], pnl, equity
        held = keep
        # a single position tests the signal it points at, then passes over older ones: one that could not
        # be taken on its bar still holds the pointer on the next; a grid uses up all signals of the bar
        while k < len(waiting) and waiting[k]["bar"] <= at[i] and (slots > 1 or waiting[k]["bar"] == at[i]):
            x = waiting[k]
            free = len(held) < slots and (daily_trades <= 0 or n_today < daily_trades) and (daily_loss <= 0 or start - equity < start * daily_loss)
            if x["bar"] == at[i] and free:
                gap = abs(x["price"] - x["sl"])
                size = equity * risk / gap * x["quality_mult"] if gap > 0 else 0.01
                held.append({"x": x, "i": i, "sl": x["sl"], "size": size, "pnl": 0.0, "far": 0.0, "trailing": False, "partial": False, "mfe": 0.0, "mae": 0.0})
                n_today += 1
            elif slots == 1:
                break
            k += 1
            if slots == 1:
                break
        while slots == 1 and k < len(waiting) and waiting[k]["bar"] < at[i]:
            k += 1
    for t in held:
        pnl = t["pnl"] + t["size"] * (t["x"]["direction"] * (close[-1] - t["x"]["price"]) - spread)
        equity += pnl
        yield t, int(at[-1]), close[-1], 6, pnl, equity


def simulate(signals: DataFrame, bars: DataFrame, keys: tuple[str, ...] = ("sym", "trial"), capital: float = 3000.0, risk: float = 0.01, slots: int = 1, daily_trades: int = 0, daily_loss: float = 0.0, spread: float = 0.0, slippage: float = 0.0) -> DataFrame:
    """Trades of each instrument and trial by the sequential kernel; ``slots`` above 1 is the grid engine.

    Signals need sym, trial, bar, seq, direction, price, sl, tp, atr and the management columns
    (``filters.management_defaults``); distances are in price. A task has one instrument and one of PARTS shares of the trials.
    """
    rows = signals.select(*keys, "bar", "seq", "direction", "price", "sl", "tp", "atr", "max_bars", "stale_bars", "be_trigger", "be_offset", "trail_mode", "trail_start", "trail_step", "chandelier_mult", "partial_pct", "partial_target", "quality_mult")
    rest = [k for k in keys if k != "sym"]
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*rest), F.lit(PARTS)).cast("int"))
    # candles go once to each part of an instrument, not once to each trial
    parts = rows.select(F.col("sym").alias("_sym"), F.col("_part").alias("_at")).distinct()
    candles = bars.select(F.col("sym").alias("_s"), F.col("bar").alias("bar"), "high", "low", "close", F.weekday("ts").alias("day"))
    candles = candles.join(parts, F.col("_s") == F.col("_sym")).drop("_s")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        right = right.sort_values("bar")
        for _, mine in left.groupby(list(keys), sort=True) if len(left) else ():
            for t, exit_bar, price, reason, pnl, equity in _kernel(mine, right, capital, risk, slots, daily_trades, daily_loss, spread, slippage):
                x, r = t["x"], abs(t["x"]["price"] - t["x"]["sl"]) or np.nan
                out.append((*(x[k] for k in keys), x["bar"], x["seq"], x["direction"], x["price"], exit_bar, price, reason, pnl, equity, exit_bar - x["bar"], t["mfe"] / r, t["mae"] / r))
        return pd.DataFrame(out, columns=names)

    names = [*keys, "bar", "seq", "direction", "price", "exit_bar", "exit_price", "reason", "pnl", "equity", "bars_held", "mfe_r", "mae_r"]
    kinds = {f.name: f.dataType.simpleString() for f in signals.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "bar int, seq int, direction int, price double, exit_bar int, exit_price double, reason int, pnl double, equity double, bars_held int, mfe_r double, mae_r double"])
    return rows.groupBy("sym", "_part").cogroup(candles.groupBy("_sym", "_at")).applyInPandas(run, schema)


def relational(exits: DataFrame, keys: tuple[str, ...] = ("sym", "trial"), capital: float = 3000.0, risk: float = 0.01) -> DataFrame:
    """Single-position trades with compounded equity from first exits, as the kernel gives them without limits and management.

    A trade is taken if no earlier taken trade is still open at its bar; the chain is followed by
    pandas over (bar, exit_bar) pairs only, and equity is a running sum of log returns.
    """

    def taken(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(["bar", "seq"], kind="stable").reset_index(drop=True)
        pick, free, blocked = [], -1, None
        for bar, rows in x.groupby("bar", sort=True).indices.items():
            take = bar >= free and blocked != bar - 1
            if take:
                pick.append(int(rows[0]))
                free = int(x["exit_bar"].iloc[rows[0]])
            if len(rows) > take:
                blocked = bar  # what was not taken stands in the way of the next bar
        return x.iloc[pick]

    kept = exits.groupBy(*keys).applyInPandas(taken, exits.schema)
    r = F.col("direction") * (F.col("exit_price") - F.col("price")) / F.abs(F.col("price") - F.col("sl")) * risk
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("exit_bar", "bar", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return kept.withColumn("r", r).withColumn("equity", capital * F.exp(F.sum(F.log1p("r")).over(w)))
