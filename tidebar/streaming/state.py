"""Stopping stateful streams, going on from their checkpoint, and reading what they remember."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter


def run_some(writer: DataStreamWriter, batches: int, seconds: float = 300.0) -> int:
    """Run a stream until it has finished ``batches`` micro-batches, and stop it wherever it then is; returns the last finished batch, -1 if none."""
    query = writer.start()
    until = time.monotonic() + seconds
    try:
        while query.isActive and time.monotonic() < until and (query.lastProgress is None or query.lastProgress["batchId"] + 1 < batches):
            time.sleep(0.05)
    finally:
        query.stop()
    if query.exception():
        raise query.exception()
    return query.lastProgress["batchId"] if query.lastProgress else -1


def run_rest(writer: DataStreamWriter) -> None:
    """Go on from the checkpoint of ``writer`` until all that is there now has been read."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def state_table(spark: SparkSession, checkpoint: str, operator: int = 0, store: str = "default") -> DataFrame:
    """What a stateful operator of a stream remembers, as its checkpoint has it: a row a key, ``key`` and ``value`` as structs."""
    rows = spark.read.format("statestore").option("operatorId", operator).option("storeName", store).load(checkpoint)
    return rows.select("key", "value")


def totals(ticks: DataFrame) -> DataFrame:
    """Count, sum and greatest price of each instrument so far: state that never ends, of a row an instrument."""
    return ticks.groupBy("sym").agg(F.count("*").alias("n"), F.sum("price").alias("total"), F.max("price").alias("top"))
