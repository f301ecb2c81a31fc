"""JSON, JSON-lines and CSV documents: reading what is sound, marking what isn't, writing ledgers."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of an exported trade, in order. Fixed values.
TRADE_COLUMNS = ("trade_id", "instrument", "direction", "units", "entry_price", "entry_time", "exit_price", "exit_time", "exit_reason", "realized_pnl", "stop_loss", "take_profit", "strategy_id")


def parsed(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Adds ``doc``: the JSON of a column by ``schema``; null fields where it can't be read."""
    return rows.withColumn("doc", F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"}))


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON documents; unreadable ones come as rows with their text in _corrupt_record, and each has its file in ``source``."""
    df = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return df.withColumn("source", F.col("_metadata.file_path"))


def trades_of(docs: DataFrame, column: str, fields: str, last: int | None = None) -> DataFrame:
    """Trades of documents that hold a list, or an object with a list under 'trades' or 'trade_history'; of each the ``last`` ones, if asked."""
    some = f"array<struct<{fields}>>"
    named = F.from_json(column, f"struct<trades: {some}, trade_history: {some}>")
    found = F.when(F.startswith(F.ltrim(column), F.lit("[")), F.from_json(column, some)).otherwise(F.coalesce(named["trades"], named["trade_history"]))
    if last is not None:
        found = F.slice(found, F.greatest(F.lit(1), F.size(found) - last + 1), last)
    return docs.select(F.explode(found).alias("t")).select("t.*")


def read_trades(spark: SparkSession, path: str, fields: str, last: int | None = None) -> DataFrame:
    """Trades of files as in ``trades_of``; one row a trade."""
    return trades_of(spark.read.text(path, wholetext=True), "value", fields, last)


def write_runs(docs: DataFrame, path: str) -> None:
    """Leave the text ``value`` of each row in a file of its folder ``run=...``, as ``read_runs`` finds it.

    In a mounted folder tasks write the files by themselves: Spark's writer there starts several processes a file to set its
    permissions. Other stores get Spark's writer.
    """
    if re.match(r"[a-z0-9+.-]+:", path) and not path.startswith("file:"):
        docs.select("run", "value").write.partitionBy("run").text(path)
        return
    at = re.sub(r"^file:/*", "/", path)

    def write(batches):
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for run, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folder = os.path.join(at, f"run={'__HIVE_DEFAULT_PARTITION__' if run is None else run}")
                os.makedirs(folder, exist_ok=True)
                final = os.path.join(folder, f"part-{task}-{k}.txt")
                part = os.path.join(folder, f".part-{task}-{k}.{os.getpid()}")
                with open(part, "w", encoding="utf-8") as f:
                    f.write(f"{'' if value is None else value}\n")
                os.replace(part, final)  # a task that runs twice leaves one file
                k += 1
            yield batch.slice(0, 0)

    os.makedirs(at, exist_ok=True)
    docs.select(F.col("run").cast("long"), "value").mapInArrow(write, "run long, value string").write.format("noop").mode("overwrite").save()


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """run, doc: the document of each folder ``run=...`` under a path; doc is null where it can't be read."""
    text = spark.read.text(path, wholetext=True)
    return parsed(text, "value", schema).select(F.col("run").cast("long").alias("run"), "doc")


def run_index(docs: DataFrame, stages: Column, order: list[str]) -> DataFrame:
    """stages_done, status and minutes of runs: stages count in order until one has failed."""
    status = F.array(*[F.coalesce(F.try_element_at(stages, F.lit(n))["status"], F.lit("pending")) for n in order])
    seconds = F.array(*[F.coalesce(F.try_element_at(stages, F.lit(n))["duration_seconds"], F.lit(0.0)) for n in order])
    failed = F.array_position(status, "failed")
    upto = F.when(failed > 0, failed).otherwise(len(order)).cast("int")
    done = F.size(F.filter(F.slice(status, F.lit(1), upto), lambda s: s == "completed"))
    total = F.aggregate(F.slice(seconds, F.lit(1), upto), F.lit(0.0), lambda a, x: a + x)
    return docs.withColumns({"stages_done": done, "status": F.when(failed > 0, "FAILED").when(done == len(order), "COMPLETE").otherwise("PARTIAL"), "minutes": total / 60})


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """A broker's CSV with a header: names in lower case with underscores, values trimmed, and ``ts`` in UTC from 'date time offset'."""
    df = spark.read.option("header", True).csv(path)
    df = df.select(*[F.trim(F.col(f"`{c}`")).alias(c.strip("﻿ ").lower().replace(" ", "_")) for c in df.columns])
    if "transaction_date" in df.columns:
        parts = F.split("transaction_date", " ")
        hours = F.try_element_at(parts, F.lit(3)).cast("int")
        df = df.withColumn("ts", F.to_timestamp(F.concat_ws(" ", parts[0], parts[1])) - F.make_interval(hours=hours))
    return df


def write_trades(trades: DataFrame, path: str) -> None:
    """CSV of the fixed trade columns; others are left out, missing ones are empty."""
    trades.select(*[F.col(c) if c in trades.columns else F.lit(None).cast("string").alias(c) for c in TRADE_COLUMNS]).write.mode("overwrite").option("header", True).csv(path)


def write_bars(bars: DataFrame, path: str) -> None:
    """Parquet by instrument, so that a scan of one reads its files alone; a hot instrument is spread over several files."""
    bars.repartition("sym", F.floor(F.col("bar") / 1_000_000)).sortWithinPartitions("sym", "bar").write.mode("overwrite").partitionBy("sym").parquet(path)
