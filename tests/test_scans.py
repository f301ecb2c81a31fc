"""Scans in blocks against plain loops, with one key that holds half of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from tidebar.operators import exits, metrics, scans


@pytest.fixture(scope="module")
def ledger():
    rng = random.Random(4)
    rows = []
    for i in range(1200):
        key = "hot" if i % 2 else rng.choice(["a", "b", None, "c"])
        rows.append((key, rng.randrange(12), i, float(rng.choice([-3, -1, 0, 2, 5]))))
    return rows


SCHEMA = "key string, day int, id long, pnl double"
ORDER = ["day", "id"]


def per_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("block", [[], ["day"], ["floor(day / 4)", "day"]])
@pytest.mark.parametrize("reverse", [False, True])
def test_scan(spark, ledger, block, reverse):
    odd = F.col("id") % 7 == 0
    df = spark.createDataFrame(ledger, SCHEMA)
    got = scans.scan(
        df, ["key"], ORDER, [F.expr(b) for b in block], sums={"n": F.lit(1), "gain": F.col("pnl")}, peaks={"top": ("gain", None), "at_odd": ("gain", odd)},
        lasts={"seen": F.when(odd, F.struct("id", "pnl"))}, reverse=reverse,
    )
    got = {r.id: r for r in got.collect()}
    assert len(got) == len(ledger)
    for rows in per_key(ledger).values():
        n, gain, top, at_odd, seen = 0, 0.0, None, None, None
        for _, _, i, pnl in reversed(rows) if reverse else rows:
            r = got[i]
            assert (r.n_before, r.gain_before, r.top_before, r.at_odd_before, r.seen_before and r.seen_before.id) == (n, gain, top, at_odd, seen)
            n, gain = n + 1, gain + pnl
            top = gain if top is None else max(top, gain)
            if i % 7 == 0:
                seen, at_odd = i, gain if at_odd is None else max(at_odd, gain)


def test_equity_and_streaks(spark, ledger):
    df = spark.createDataFrame(ledger, SCHEMA)
    eq = {r.id: r for r in metrics.equity(df, ["key"], ORDER, 10.0, [F.col("day")]).collect()}
    runs = {r.key: (r.win_streak, r.loss_streak) for r in metrics.streaks(df, ["key"], ORDER, [F.col("day")]).collect()}
    for key, rows in per_key(ledger).items():
        e = peak = 10.0
        best, now = [0, 0], [0, 0]
        for k, (_, _, i, pnl) in enumerate(rows):
            e += pnl
            peak = max(peak, e)
            assert (eq[i].n, eq[i].equity, eq[i].peak, eq[i].drawdown) == (k + 1, e, peak, peak - e)
            side = int(pnl <= 0)
            now[side], now[1 - side] = now[side] + 1, 0
            best[side] = max(best[side], now[side])
        assert runs[key] == tuple(best)


def test_no_window_holds_a_whole_key(spark, ledger):
    """No window sorts the rows of a key in one task: those by key alone have a row a block."""
    df = spark.createDataFrame(ledger, SCHEMA)
    plan = metrics.equity(df, ["key"], ORDER, 10.0, [F.col("day")])._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line and "_block0" not in line.split("], [")[1]:
            assert "[_block0" in line.split("], [")[2]  # ordered by the block
    assert metrics.equity(df.limit(0), ["key"], ORDER, 10.0, [F.col("day")]).count() == 0


@pytest.mark.parametrize("n", [1, 3, 4, 5, 13, 40])
def test_folds_are_ntiles(spark, n):
    rows = spark.range(n).select(F.lit("a").alias("sym"), (F.col("id") * 3).cast("int").alias("bar"))
    got = sorted((r.fold, r.bar, r.role) for r in exits.folds(rows, 4).collect())
    sizes = [n // 5 + (k < n % 5) for k in range(5)]
    part = [k for k, s in enumerate(sizes) for _ in range(s)]
    assert got == sorted((f, 3 * i, "train" if p <= f else "test") for i, p in enumerate(part) for f in range(4) if p <= f + 1)


@pytest.mark.parametrize("block", [[], ["day"], ["floor(day / 4)", "day"]])
def test_streaks_by_blocks(spark, ledger, block):
    """Runs over many blocks, blocks of one side only, keys with one trade and without a result; trades are sorted once and not joined."""
    rows = ledger + [("won", i // 3, i, 1.0) for i in range(30)] + [("lost", i // 7, i, 0.0) for i in range(30)] + [("one", 3, 1, 2.0), ("none", 3, 1, None)] + [("cut", i // 3, i, None if i == 13 else 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = metrics.streaks(df, ["key"], ORDER, block)
    want = {}
    for key, mine in per_key(rows).items():
        best, now = [0, 0], [0, 0]
        for *_, pnl in mine:
            now = [0, 0] if pnl is None else [now[0] + 1, 0] if pnl > 0 else [0, now[1] + 1]
            best = [max(b, n) for b, n in zip(best, now)]
        want[key] = tuple(best)
    assert {r.key: (r.win_streak, r.loss_streak) for r in got.collect()} == want
    assert (want["won"], want["lost"], want["one"], want["none"], want["cut"]) == ((30, 0), (0, 30), (1, 0), (0, 0), (16, 0))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert dict(got.dtypes) == {"key": "string", "win_streak": "bigint", "loss_streak": "bigint"}
