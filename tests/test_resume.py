"""Streams that stop and go on, and stages that run only where something changed."""

import pytest
from pyspark.sql import functions as F

from tidebar.operators import stages as T
from tidebar.streaming import candles, state


def test_stopped_stream_gives_what_an_unbroken_one_gives(spark, data, tmp_path):
    spark.read.parquet(f"{data}/events.parquet").repartitionByRange(8, "ts", "event_id").write.parquet(f"{tmp_path}/ticks")

    def writer(name):
        rows = candles.closed_candles(candles.ticks(spark, f"{tmp_path}/ticks", files_per_trigger=1), "4 hours")
        return rows.writeStream.format("parquet").option("path", f"{tmp_path}/{name}/out").option("checkpointLocation", f"{tmp_path}/{name}/state")

    state.run_rest(writer("whole"))
    reached = state.run_some(writer("broken"), 3)
    assert 2 <= reached < 7
    held = state.state_table(spark, f"{tmp_path}/broken/state")
    assert held.count() > 0 and {"key", "value"} == set(held.columns)
    state.run_rest(writer("broken"))
    rows = lambda name: sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{name}/out").collect()))
    assert rows("broken") == rows("whole") and rows("whole")


@pytest.fixture
def tables(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/a")
    spark.range(5).write.parquet(f"{tmp_path}/b")
    return {"a": f"{tmp_path}/a", "b": f"{tmp_path}/b"}


def flow(calls, factor=2, fail=False):
    def double(a):
        calls.append("double")
        return a.select((F.col("id") * factor).alias("id"))

    def count_b(b):
        calls.append("count_b")
        return b.agg(F.count("*").alias("n"))

    def both(double, count_b):
        calls.append("both")
        if fail:
            raise KeyError("killed")
        return double.join(F.broadcast(count_b))  # one row

    return [T.Stage("double", ["a"], double, version=str(factor)), T.Stage("count_b", ["b"], count_b), T.Stage("both", ["double", "count_b"], both, lambda: F.max("n") < 7)]


def test_only_what_depends_on_a_change_runs(spark, tables, tmp_path):
    folder, calls = f"{tmp_path}/runs", []
    with pytest.raises(KeyError):
        T.run(spark, folder, tables, flow(calls, fail=True))
    calls.clear()
    assert T.run(spark, folder, tables, flow(calls))["both"].count() == 10
    assert calls == ["both"]  # the killed run had finished the others
    T.run(spark, folder, tables, flow(calls))
    assert calls == ["both"]
    calls.clear()
    T.run(spark, folder, tables, flow(calls, factor=3))
    assert calls == ["double", "both"]
    outputs = sorted(p.name.split("-")[0] for p in (tmp_path / "runs" / "outputs").iterdir() if not p.name.startswith("."))
    assert outputs == ["both", "count_b", "double"]
    calls.clear()
    spark.range(1).write.mode("append").parquet(tables["b"])
    T.run(spark, folder, tables, flow(calls, factor=3))
    assert calls == ["count_b", "both"]
    calls.clear()
    spark.range(2).write.mode("append").parquet(tables["b"])
    with pytest.raises(T.GateClosed):
        T.run(spark, folder, tables, flow(calls, factor=3))
    assert calls == ["count_b", "both"]
    last = T.manifest(spark, folder).filter("run = 6").collect()
    assert {r.stage: (r.status, r.rows) for r in last} == {"double": ("skipped", 10), "count_b": ("ran", 1), "both": ("failed", 10)}
