"""Pages of documents as a source of tables and streams: ``spark.read.format("pages")`` and ``spark.readStream.format("pages")``.

A service that answers in pages leaves each answer as a file of JSON lines in a folder that driver and executors
share: ``<path>/<group>/<from>-<to>-<seq>.json``, with the microseconds its rows lie between and the number the answer came with.
The driver plans from names alone: filters on the group and on the time drop whole pages, what stays is cut into
partitions of some pages each, and executors read only these. As a stream, the offset is the number of the last page read.
Rows come as they stand in the pages: repeated where pages overlap, and not yet complete where the newest page was taken early.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

_NAME = re.compile(r"(-?\d+)-(-?\d+)-(\d+)\.json")


class Pages(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


def _local(path: str) -> str:
    """A path of a mounted folder; other stores have no pages that workers could open."""
    if re.match(r"[a-z0-9+.-]+:", path) and not path.startswith("file:"):
        raise ValueError(f"pages are read from mounted folders, not from {path}")
    return re.sub(r"^file:/*", "/", path)


def _listed(path: str) -> list[tuple[str, int, int, int, str]]:
    """(group, from, to, seq, file) of every page, by names."""
    out = []
    for group in sorted(os.listdir(path)):
        folder = os.path.join(path, group)
        if os.path.isdir(folder) and not group.startswith(("_", ".")):
            for name in sorted(os.listdir(folder)):
                if m := _NAME.fullmatch(name):
                    out.append((group, int(m[1]), int(m[2]), int(m[3]), os.path.join(folder, name)))
    return out


def _rows(files: list[str], schema: StructType) -> Iterator[tuple]:
    for file in files:
        with open(file, encoding="utf-8") as f:
            for line in f:
                try:
                    doc = json.loads(line)
                except ValueError:
                    continue  # a page that broke off
                yield tuple(datetime.fromisoformat(v) if c.dataType.typeName() == "timestamp" and v is not None else v for c in schema for v in (doc.get(c.name),))


def _micros(at: datetime) -> int:
    return round((at if at.tzinfo else at.astimezone(timezone.utc)).timestamp() * 1e6)


def _dealt(files: list[str], each: int) -> list[Pages]:
    return [Pages(files[i : i + each]) for i in range(0, len(files), each)]


class PageReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, group: str, time: str, each: int):
        self.path, self.schema, self.group, self.time, self.each = path, schema, group, time, each
        self.groups, self.low, self.high = None, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what names can tell; rows are filtered by Spark all the same, as a page may reach over the bounds."""
        for f in filters:
            at = ".".join(f.attribute) if hasattr(f, "attribute") else None
            if at == self.group and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.groups = values if self.groups is None else self.groups & values
            elif at == self.time and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)) and f.value is not None:
                self.low = max(_micros(f.value), self.low if self.low is not None else _micros(f.value))
            if at == self.time and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)) and f.value is not None:
                self.high = min(_micros(f.value), self.high if self.high is not None else _micros(f.value))
            yield f

    def partitions(self) -> list[Pages]:
        kept = [
            file for group, start, end, _, file in _listed(self.path)
            if (self.groups is None or group in self.groups) and (self.low is None or end >= self.low) and (self.high is None or start <= self.high)
        ]
        return _dealt(kept, self.each)

    def read(self, partition: Pages) -> Iterator[tuple]:
        return _rows(partition.files if partition else [], self.schema)


class PageStream(DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType, each: int):
        self.path, self.schema, self.each = path, schema, each

    def initialOffset(self) -> dict:
        return {"page": -1}

    def latestOffset(self) -> dict:
        return {"page": max((p[3] for p in _listed(self.path)), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return _dealt([p[4] for p in sorted(_listed(self.path), key=lambda p: p[3]) if start["page"] < p[3] <= end["page"]], self.each)

    def read(self, partition: Pages) -> Iterator[tuple]:
        return _rows(partition.files if partition else [], self.schema)

    def commit(self, end: dict) -> None:
        """Pages stay where they are."""


class PageSource(DataSource):
    """Options: path, group (name of the column that names the folder), time (name of the time column), pages (files a partition)."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def _given(self) -> tuple[str, int]:
        return _local(self.options["path"]), int(self.options.get("pages", "8"))

    def reader(self, schema: StructType) -> PageReader:
        path, each = self._given()
        return PageReader(path, schema, self.options.get("group", "sym"), self.options.get("time", "ts"), each)

    def streamReader(self, schema: StructType) -> PageStream:
        path, each = self._given()
        return PageStream(path, schema, each)


CANDLE = "sym string, ts timestamp, open double, high double, low double, close double, volume long, complete boolean"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_pages(rows: DataFrame, group: str, time: str, page: str, path: str) -> None:
    """Leave rows as pages, as the service would: ``page`` has the number a row's page came with; one task writes a page."""
    at = _local(path)
    columns = rows.columns
    iso = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias(c) if rows.schema[c].dataType.typeName() == "timestamp" else F.col(c) for c in columns if c != page]
    lines = rows.select(F.col(group).alias("_group"), F.col(page).alias("_page"), F.unix_micros(time).alias("_at"), F.to_json(F.struct(*iso)).alias("_line"))

    def write(table):
        group, number = table.column("_group")[0].as_py(), table.column("_page")[0].as_py()
        times = table.column("_at").to_pylist()
        folder = os.path.join(at, group)
        os.makedirs(folder, exist_ok=True)
        final = os.path.join(folder, f"{min(times)}-{max(times)}-{number}.json")
        part = f"{final}.{os.getpid()}.part"
        with open(part, "w", encoding="utf-8") as f:
            f.write("\n".join(table.column("_line").to_pylist()))
        os.replace(part, final)  # a task that runs twice leaves one page
        return table.select(["_page"]).slice(0, 1)

    lines.groupBy("_group", "_page").applyInArrow(write, f"_page {rows.schema[page].dataType.simpleString()}").write.format("noop").mode("overwrite").save()


def closed_once(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Complete rows only, one for each key: that of the greatest ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.filter("complete").withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
