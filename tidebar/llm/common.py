"""Helpers shared by the corpus operators: shared work folders, Arrow slices, word splitting."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step inside a task holds in split form at a time, but for a single longer text.
SLICE_BYTES = 600_000


def workdir(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share, removed when the application ends.

    It lies under ``spark.checkpoint.dir``. Only where that is unset and Spark runs in one
    process, as in tests, a temporary folder is used and registered as the checkpoint folder; on
    a cluster that is an error, as executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidebar-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/tidebar-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return f"{folder}/work"


def materialize(df: DataFrame, path: str, rows_a_file: int = 0) -> DataFrame:
    """Write ``df`` to ``path`` and read it again: lineage ends there, and a lost executor costs no rework.

    Rows of megabytes need ``rows_a_file``: a writer looks at its memory after 100 rows, and a reader holds up to 4,096 of a file at once.
    """
    out = df.write.mode("overwrite").option("compression", "zstd")
    (out.option("maxRecordsPerFile", rows_a_file) if rows_a_file else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table of an earlier round that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut batches into runs of whole rows of about ``size`` bytes of text; null texts come as ''.

    The cut is made on the Arrow column, so only one run at a time exists as Python strings.
    """
    for batch in batches:
        at = batch.schema.names.index(column)
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(batch):
            end = min(len(batch), int(np.searchsorted(upto, (upto[start - 1] if start else 0) + size)) + 1)
            part = batch.slice(start, end - start)
            yield part, [t or "" for t in part.column(at).to_pylist()]
            start = end
        del batch, part
        pa.default_memory_pool().release_unused()


#: Keys that a join deals over several tasks: at most so many, of more rows than these, over so many tasks.
HOT_KEYS, HOT_ROWS, HOT_TASKS = 1000, 500, 256


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """The keys of most rows, at most ``HOT_KEYS``, with ``__salts``: the tasks to deal each over.

    No other key has more than one row in ``HOT_KEYS``. The list is bounded, so it may be broadcast; it is fixed here, so
    that all its uses agree.
    """
    salts = F.least(F.lit(HOT_TASKS), F.ceil(F.col(n) / HOT_ROWS)).cast("int").alias("__salts")
    found = counts.filter(F.col(n) > HOT_ROWS).orderBy(F.desc(n)).limit(HOT_KEYS).select(*keys, salts)
    return F.broadcast(counts.sparkSession.createDataFrame(found.collect(), found.schema))


def dealt(many: DataFrame, hot: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``many`` with ``__salt``: rows of hot keys, and rows without a key, are dealt by a column's hash."""
    lone = F.when(F.col(keys[0]).isNull(), HOT_TASKS).otherwise(1)
    return many.join(hot, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(by), F.coalesce("__salts", lone)).cast("int")).drop("__salts")


def repeated(one: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """``one``, which has each key once, with a row for each ``__salt`` of its key."""
    return one.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")


def join_hot(many: DataFrame, one: DataFrame, keys: list[str], by: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """Join ``many`` rows to ``one`` row a key, where a few keys, or a missing one, may have a third of all rows."""
    hot = hot_keys(many.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts, keys)
    return dealt(many, hot, keys, by).join(repeated(one, hot, keys), [*keys, "__salt"], how).drop("__salt")


_resident: dict[tuple, object] = {}
#: The C library keeps freed blocks of up to 32 MB for the process; where it has this call, it lets go of them.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def resident(*key: object, make: Callable[[], object]) -> object:
    """What this Python worker keeps under ``key`` for its next tasks: one thing at a time, made anew where another was kept."""
    if key not in _resident:
        let_go()
        _resident[key] = make()
    return _resident[key]


def let_go() -> None:
    """Free what an operator before kept in this worker, and give it back to the system; tasks of operators with tables of their own begin with it."""
    _resident.clear()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def quiet_tokenizers() -> None:
    """Spark starts as many tasks as there are cores; the library starts no threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
