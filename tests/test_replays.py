"""Replays: filters know all that was archived and little else; batches that run again change nothing."""

from pyspark.sql import functions as F

from tidebar.streaming import replays


def test_filters(spark):
    rows = spark.range(3000).select((F.col("id") * 7).alias("k"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 3).cast("int")).alias("day"))
    filters = replays.filters_of(rows, ["k"])
    assert replays.maybe_known(rows, filters, ["k"]).count() == 3000
    others = rows.withColumn("k", F.col("k") + 1)
    assert replays.maybe_known(others, filters, ["k"]).count() < 30
    assert replays.maybe_known(rows.withColumn("day", F.date_add("day", 10)), filters, ["k"]).count() == 0


def test_late_replays_and_repeated_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(replays, "BITS", 64)  # nearly every row may be known: the archive decides
    schema = "k long, ts timestamp, v int"

    def land(name, ids, v):
        rows = spark.createDataFrame([(i, v) for i in ids], "k long, v int").withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("k") * 40_000))
        rows.select("k", "ts", "v").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        q = replays.archive_once(stream, ["k"], "ts", f"{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/out/rows").collect())

    land("a", list(range(40)) + [3, 3, 5], 1)
    assert run() == [(i, 1) for i in range(40)]
    land("b", range(30, 60), 2)
    want = [(i, 1 if i < 40 else 2) for i in range(60)]
    assert run() == want and run() == want
    land("c", range(60), 3)
    assert run() == want
    # a batch that ran but wasn't committed runs again
    checkpoint = tmp_path / "out" / "checkpoint" / "commits"
    last = max(int(p.name) for p in checkpoint.iterdir() if p.name.isdigit())
    for p in checkpoint.iterdir():
        if p.name.strip(".").split(".")[0] == str(last):
            p.unlink()
    assert run() == want
