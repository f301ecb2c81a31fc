"""A refresh leaves other folders alone; spans come from footers."""

import os

from pyspark.sql import functions as F

from tidebar.sources import cache


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(spark, ids, load):
    return spark.createDataFrame([(f"s{i % 3}", i // 10, i, load) for i in ids], "sym string, part int, id long, load int")


def test_refresh_replaces_only_touched_folders(spark, tmp_path):
    path = f"{tmp_path}/cache"
    cache.write(rows(spark, range(60), 1), path, ["sym", "part"])
    before = files(path)
    cache.refresh(spark, path, rows(spark, [57, 60, 63], 2), ["sym", "id"], "load", ["sym", "part"])
    after = files(path)
    same = {f for f in before if after.get(f) == before[f]}
    assert {f.split("/cache/")[1].rsplit("/", 1)[0] for f in before.keys() - same} == {"sym=s0/part=5"}
    got = sorted((r.id, r.load) for r in spark.read.parquet(path).collect())
    assert got == [(i, 2 if i == 57 else 1) for i in range(60)] + [(60, 2), (63, 2)]
    cache.refresh(spark, path, rows(spark, [], 3), ["sym", "id"], "load", ["sym", "part"])
    assert files(path) == after


def test_spans_read_no_rows(spark, tmp_path):
    df = spark.range(90).select((F.col("id") % 3).cast("string").alias("sym"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    cache.write(df, f"{tmp_path}/c", ["sym"])
    kept = {k: spark.conf.get(k) for k in ("spark.sql.sources.useV1SourceList", "spark.sql.parquet.aggregatePushdown")}
    got = sorted((str(r["sym"]), str(r["first"]), str(r["last"]), r["n"]) for r in cache.spans(spark, f"{tmp_path}/c", "sym", "day").collect())
    assert got == [("0", "2024-01-01", "2024-03-28", 30), ("1", "2024-01-02", "2024-03-29", 30), ("2", "2024-01-03", "2024-03-30", 30)]
    assert kept == {k: spark.conf.get(k) for k in kept}
    one = spark.createDataFrame([("x", "2024-01-01", "2024-01-10")], "sym string, first string, last string")
    half = spark.createDataFrame([("x", "2024-01-06", "2024-01-10"), ("y", "2024-01-01", "2024-01-02")], "sym string, first string, last string")
    assert {r.sym: r.source for r in cache.chosen(half, one, "sym").collect()} == {"x": "direct", "y": "derived"}
