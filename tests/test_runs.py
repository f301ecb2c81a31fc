"""Folders of runs: written without a process a file, read back whole."""

import os
from datetime import datetime, timedelta

from tidebar.plans import catalog, flows
from tidebar.sources import documents as D


def test_runs_are_written_by_tasks(spark, tmp_path):
    rows = [(n, None if n == 4 else '{"status": "s%d"}' % n if n % 3 else "{half") for n in range(40)] + [(7, '{"status": "again"}')]
    for _ in range(2):  # a job that runs twice leaves the same files
        D.write_runs(spark.createDataFrame(rows, "run long, value string").coalesce(1), f"{tmp_path}/runs")
    found = sorted((r.run, r.doc.status if r.doc else None) for r in D.read_runs(spark, f"{tmp_path}/runs", "status string").collect() if r.run != 7)
    assert found == [(n, None if n == 4 or n % 3 == 0 else f"s{n}") for n in range(40) if n != 7]
    assert len(os.listdir(f"{tmp_path}/runs/run=7")) == 2


def test_pages_of_transactions_grow_with_rows(spark, tmp_path, monkeypatch):
    """40 books of 25 transactions dealt over all ids make a page each, not one for each range of ids they meet."""
    rows = [(i * 50, "click", i % 40 * 1000, 1.5, datetime(2024, 1, 1) + timedelta(seconds=i)) for i in range(1000)]
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long, value double, ts timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(flows, "workdir", lambda _: f"{tmp_path}/work")
    found = catalog.QUERIES["s05_transaction_pages"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == [r[:4] for r in rows]
    assert len([f for _, _, files in os.walk(f"{tmp_path}/work/pages") for f in files]) == 40
