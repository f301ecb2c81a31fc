"""Cached tables in partitions: refreshing only what new rows touch, and judging sources by their footers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import keep_last


def write(rows: DataFrame, path: str, parts: list[str]) -> None:
    """Write a cache, one folder for each value of ``parts``; rows of a folder come together first, so it gets few files."""
    rows.repartition(*parts).write.mode("overwrite").partitionBy(*parts).parquet(path)


def refresh(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], order: str, parts: list[str]) -> None:
    """Put ``rows`` into a cache; of rows with equal keys that of the greatest ``order`` stays.

    Only folders that ``rows`` fall into are read and replaced; all others keep their files.
    """
    touched = rows.select(*parts).distinct()
    old = spark.read.schema(rows.schema).parquet(path).join(touched, parts, "left_semi")
    merged = keep_last(old.select(*rows.columns).unionByName(rows), keys, order)
    merged.repartition(*parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def spans(spark: SparkSession, path: str, by: str, day: str) -> DataFrame:
    """by, first, last, n of each folder of a cache partitioned by ``by``: from the footers of its files, no row is read.

    The result is a row a folder and is made at once, as the reader that takes aggregates is chosen by settings that are put back.
    """
    wanted = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        found = spark.read.parquet(path).groupBy(by).agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count("*").alias("n"))
        return spark.createDataFrame(found.collect(), found.schema)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def chosen(fine: DataFrame, direct: DataFrame, by: str, share: float = 0.8) -> DataFrame:
    """For each instrument of two spans (first, last as dates): 'derived' where the fine source covers ``share`` of the days asked for, else 'direct', else 'download'."""
    days = lambda d, name: d.select(by, (F.datediff("last", "first") + 1).alias(name))
    x = days(fine, "fine_days").join(days(direct, "direct_days"), by, "full_outer").na.fill(0, ["fine_days", "direct_days"])
    asked = F.greatest("fine_days", "direct_days")
    return x.withColumn("source", F.when((F.col("fine_days") > 0) & (F.col("fine_days") >= share * asked), "derived").when(F.col("direct_days") > 0, "direct").otherwise("download"))
