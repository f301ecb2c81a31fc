"""Stages that resume: outputs keyed by what they were made from, a manifest, and gates that stop a run.

A stage's key is a digest of the keys of its inputs, of its code and of a version. An output is used again where the
manifest has its key, so a killed run goes on behind its last finished stage, and a changed input or
stage makes anew only what depends on it. The manifest gets a stage's row after its output is complete: what a killed
stage left is not in it, and goes, with all outputs that no run names any more, when the next run is done.
"""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class GateClosed(RuntimeError):
    """A stage's output doesn't pass its gate; later stages didn't run."""


@dataclass
class Stage:
    """``make`` gets the outputs of ``needs`` by name; ``gate`` is an aggregate that must be true of the output."""

    name: str
    needs: list[str]
    make: Callable[..., DataFrame]
    gate: Callable[[], Column] | None = None
    version: str = ""

    def code(self) -> str:
        try:
            return inspect.getsource(self.make)
        except OSError:
            return self.make.__qualname__


_MANIFEST = "stage string, key string, path string, status string, rows long, run long"


def fingerprint(spark: SparkSession, path: str) -> str:
    """Digest of a Parquet table's files: names, sizes and times, from listings and footers; no column is read."""
    file = F.xxhash64("_metadata.file_name", "_metadata.file_size", "_metadata.file_modification_time")
    files = spark.read.parquet(path).select(file.alias("h")).distinct()
    x = files.agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.bit_xor(F.xxhash64("h", F.lit(1))).alias("y")).first()
    return hashlib.sha256(f"{path}|{x.n}|{x.x}|{x.y}".encode()).hexdigest()[:16]


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """All finished stages of all runs: stage, key, path, status (ran, skipped or failed), rows, run."""
    files = _files(spark, folder)[0]
    if not files.exists(_files(spark, f"{folder}/manifest")[1]):
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).json(f"{folder}/manifest")


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def run(spark: SparkSession, folder: str, inputs: dict[str, str], stages: list[Stage]) -> dict[str, DataFrame]:
    """Run ``stages`` in their order over Parquet tables ``inputs`` (name: path); returns the outputs by name.

    One row a stage goes to the manifest, which the driver reads: as many rows as there are runs and stages.
    """
    past = manifest(spark, folder).collect()
    number = max((r.run for r in past), default=0) + 1
    finished = {(r.stage, r.key): r for r in past if r.status == "ran" and _files(spark, r.path)[0].exists(_files(spark, r.path)[1])}
    keys = {name: fingerprint(spark, path) for name, path in inputs.items()}
    tables = {name: spark.read.parquet(path) for name, path in inputs.items()}

    def record(stage: str, key: str, path: str, status: str, rows: int) -> None:
        spark.createDataFrame([(stage, key, path, status, rows, number)], _MANIFEST).coalesce(1).write.mode("append").json(f"{folder}/manifest")

    kept = set()
    for stage in stages:
        key = hashlib.sha256("|".join([stage.name, stage.version, stage.code(), *[keys[n] for n in stage.needs]]).encode()).hexdigest()[:16]
        path, keys[stage.name] = f"{folder}/outputs/{stage.name}-{key}", key
        kept.add(f"{stage.name}-{key}")
        done = finished.get((stage.name, key))
        if done is None:
            stage.make(*[tables[n] for n in stage.needs]).write.mode("overwrite").parquet(path)
        tables[stage.name] = spark.read.parquet(path)
        if done is not None:
            record(stage.name, key, path, "skipped", done.rows)
            continue
        passed = (stage.gate() if stage.gate else F.lit(True)).alias("passed")
        found = tables[stage.name].agg(F.count("*").alias("rows"), passed).first()
        record(stage.name, key, path, "ran" if found.passed else "failed", found.rows)
        if not found.passed:
            raise GateClosed(f"stage {stage.name} of run {number}")
    _remove_stale(spark, f"{folder}/outputs", kept)
    return {stage.name: tables[stage.name] for stage in stages}


def _remove_stale(spark: SparkSession, outputs: str, kept: set[str]) -> None:
    """Remove outputs that the run just done doesn't use; a later run makes them anew if it needs them."""
    files, at = _files(spark, outputs)
    for found in files.listStatus(at):
        if found.getPath().getName() not in kept:
            files.delete(found.getPath(), True)
