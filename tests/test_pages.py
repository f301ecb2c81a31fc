"""Pages: what is planned from names, broken pages, and a stream that goes on where it stopped."""

import json

import pytest
from pyspark.sql import functions as F

from tidebar.sources import pages


def write(folder, group, number, rows, broken=False):
    at = [r[0] for r in rows]
    (folder / group).mkdir(parents=True, exist_ok=True)
    lines = [json.dumps({"sym": group, "ts": f"2024-01-01T00:{m:02}:00+00:00", "close": c, "complete": done}) for m, c, done in rows]
    micros = lambda m: (1_704_067_200 + 60 * m) * 1_000_000
    (folder / group / f"{micros(min(at))}-{micros(max(at))}-{number}.json").write_text("\n".join(lines) + ("\n{half" if broken else ""))


@pytest.fixture
def folder(tmp_path):
    write(tmp_path, "a", 0, [(0, 1.0, True), (1, 2.0, True)])
    write(tmp_path, "a", 1, [(1, 2.0, True), (2, 3.0, True)], broken=True)
    write(tmp_path, "b", 2, [(0, 9.0, True), (30, 8.0, False)])
    (tmp_path / "a" / "0-1-7.json.5.part").write_text("{")
    return tmp_path


def test_names_decide_what_is_read(spark, folder):
    pages.register(spark)
    df = spark.read.format("pages").schema(pages.CANDLE).option("pages", 1).load(str(folder))
    assert df.count() == 6 and df.rdd.getNumPartitions() == 3
    assert sorted((r.sym, r.close) for r in pages.closed_once(df, ["sym", "ts"], "close").collect()) == [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 9.0)]
    late = df.filter(F.col("ts") > F.lit("2024-01-01 00:01:30").cast("timestamp"))
    assert sorted(r.close for r in late.collect()) == [3.0, 8.0] and late.rdd.getNumPartitions() == 2
    one = df.filter(F.col("sym").isin("b") & (F.col("ts") <= F.lit("2024-01-01 00:00:00").cast("timestamp")))
    assert [r.close for r in one.collect()] == [9.0] and one.rdd.getNumPartitions() == 1
    assert df.filter("sym = 'c'").count() == 0


def test_other_stores_are_refused(spark):
    pages.register(spark)
    with pytest.raises(Exception, match="mounted folders"):
        spark.read.format("pages").schema(pages.CANDLE).load("hdfs://somewhere/pages").count()


def test_stream_goes_on_from_its_offset(spark, folder, tmp_path_factory):
    pages.register(spark)
    out = tmp_path_factory.mktemp("out")

    def run():
        q = spark.readStream.format("pages").schema(pages.CANDLE).load(str(folder)).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").start()
        q.processAllAvailable()
        q.stop()
        return spark.read.parquet(f"{out}/rows").count()

    assert run() == 6
    write(folder, "b", 3, [(31, 7.0, True)])
    assert run() == 7 and run() == 7


def test_written_pages_come_back(spark, tmp_path):
    pages.register(spark)
    rows = spark.range(25).select(F.lit("a").alias("sym"), F.timestamp_micros(F.col("id") * 60_000_000 + 123_456).alias("ts"), F.col("id").cast("double").alias("close"), (F.col("id") < 24).alias("complete"), F.floor(F.col("id") / 10).alias("page"))
    pages.write_pages(rows, "sym", "ts", "page", str(tmp_path / "p"))
    pages.write_pages(rows, "sym", "ts", "page", str(tmp_path / "p"))
    back = spark.read.format("pages").schema("sym string, ts timestamp, close double, complete boolean").load(str(tmp_path / "p"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.drop("page").collect()))
    assert len(list((tmp_path / "p" / "a").iterdir())) == 3
