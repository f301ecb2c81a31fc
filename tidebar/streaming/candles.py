"""Structured Streaming: closed candles, deduplication, daily statistics, positions and heartbeats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TICK_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def ticks(spark: SparkSession, path: str, files_per_trigger: int = 100, more: list[str] | None = None) -> DataFrame:
    """Ticks from a folder of Parquet files, as they come, with ``more`` of their columns."""
    raw = spark.readStream.schema(TICK_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.select(F.col("event_type").alias("sym"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), *(more or []))


def closed_candles(stream: DataFrame, width: str, settle: str = "2 seconds") -> DataFrame:
    """Candles of closed windows only: a window is sent once, when the watermark has passed its end by ``settle``."""
    first = F.struct("ts", "seq")
    return stream.withWatermark("ts", settle).groupBy("sym", F.window("ts", width).alias("w")).agg(
        F.min_by("price", first).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", first).alias("close"), F.count("*").alias("volume"),
    ).select("sym", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def without_repeats(stream: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first of rows that share keys, within the time rows may come late."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def daily(stream: DataFrame) -> DataFrame:
    """Trades, wins and profit of each closed day."""
    return stream.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("trades"), F.count_if(F.col("pnl") > 0).alias("wins"), F.sum("pnl").alias("pnl")).select(F.to_date("w.start").alias("day"), "trades", "wins", "pnl")


def not_at_broker(local: DataFrame, broker: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a stream whose keys a snapshot doesn't have: positions closed elsewhere."""
    return local.join(broker.select(*keys), keys, "left_anti")


def marked_occupied(stream: DataFrame, positions: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``occupied``: whether some instance holds a position of the row's keys; each has one row in ``positions``."""
    return stream.join(positions.select(*keys).withColumn("_held", F.lit(True)), keys, "left").withColumn("occupied", F.coalesce("_held", F.lit(False))).drop("_held")


_POSITION = "trade_id long, bar_number int, action string, old_sl double, new_sl double"
_STATE = "direction int, price double, sl double, far double, bars int, even boolean, trailing boolean"


def managed(candles: DataFrame, be_trigger: float, be_offset: float, trail_start: float, trail_step: float, close_after: int) -> DataFrame:
    """Management actions of open positions, candle by candle.

    ``candles`` has one row for each open position and candle: trade_id, ts, direction, price, sl,
    high, low. The first candle of a position opens it. Stops only tighten: break-even once, then trailing; a
    touched stop, or ``close_after`` candles, end the position and drop its state.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        rows = pd.concat(list(frames)).sort_values("ts")
        held = list(state.get) if state.exists else None
        for r in rows.itertuples(index=False):
            if held is None:
                held = [int(r.direction), float(r.price), float(r.sl), 0.0, 0, False, False]
                continue
            d, price, sl, far, bars, even, trailing = held
            bars += 1
            worst, best = (r.low, r.high) if d == 1 else (r.high, r.low)
            if d * worst <= d * sl or bars >= close_after:
                out.append((key[0], bars, "stop" if d * worst <= d * sl else "time", sl, sl))
                held = None
                state.remove()
                break
            far, new = max(far, d * (best - price)), sl
            if not even and far >= be_trigger > 0:
                even, new = True, d * max(d * new, d * (price + d * min(be_offset, be_trigger)))
            if far >= trail_start > 0:
                trailing, new = True, d * max(d * new, d * (price + d * (far - min(trail_step, trail_start))))
            if new != sl:
                out.append((key[0], bars, "trail" if trailing else "breakeven", sl, new))
            held = [d, price, new, far, bars, even, trailing]
        if held is not None:
            state.update(tuple(held))
        yield pd.DataFrame(out, columns=["trade_id", "bar_number", "action", "old_sl", "new_sl"])

    return candles.groupBy("trade_id").applyInPandasWithState(step, _POSITION, _STATE, "append", GroupStateTimeout.NoTimeout)


def merge_days(days: DataFrame, path: str) -> None:
    """A foreachBatch sink that keeps one row a day, the newest, at ``path``: running a batch again changes nothing.

    A new version is written beside the old and named by its batch, so readers never see half of one.
    """
    days.write.mode("overwrite").partitionBy("day").option("partitionOverwriteMode", "dynamic").parquet(path)
