"""Hand-made cases of the simulator: long from 100, stop 98, target 104, capital 1000, risk 1 % (1 R = 10)."""

import pandas as pd
import pytest

from tidebar.operators import filters as P
from tidebar.operators import simulate as X

CASES = {
    "both touched: the stop": ([(104.5, 97.5, 100)], {}, 0, -1.0),
    "target": ([(104, 99, 103)], {}, 1, 2.0),
    "break-even, then stop": ([(102, 99, 101), (101, 99.9, 100)], {"be_trigger": 1.5, "be_offset": 0.2}, 0, 0.1),
    "trailing": ([(103, 99.5, 102.5), (103.2, 101.9, 102)], {"trail_start": 2.0, "trail_step": 1.0}, 2, 1.0),
    "partial": ([(102, 99, 101), (101, 97, 98)], {"partial_pct": 0.5, "partial_target": 1.5}, 0, -0.125),
    "time": ([(101, 99, 100.5)] * 3, {"max_bars": 3}, 3, 0.25),
    "stale": ([(101, 99, 100.1)] * 2, {"stale_bars": 2, "atr": 1.0}, 4, 0.05),
    "end of data": ([(100.5, 99.5, 100.2)], {}, 6, 0.1),
}


def frames(spark, bars, signals):
    rows = [("A", f"2024-01-02 {h:02d}:00:00", h, 100.0, float(hi), float(lo), float(c)) for h, (hi, lo, c) in enumerate([(100, 100, 100), *bars])]
    b = spark.createDataFrame(rows, "sym string, t string, bar int, open double, high double, low double, close double").selectExpr("sym", "to_timestamp(t) ts", "bar", "open", "high", "low", "close")
    s = spark.createDataFrame(pd.DataFrame(signals))
    for c, k in (("trial", "int"), ("bar", "int"), ("seq", "int"), ("direction", "int")):
        s = s.withColumn(c, s[c].cast(k))
    return b, P.management_defaults(s)


def signal(sign=1, **more):
    return {"sym": "A", "trial": 0, "bar": 0, "seq": 0, "direction": sign, "price": 100.0, "sl": 100.0 - 2 * sign, "tp": 100.0 + 4 * sign, "atr": 1.0} | more


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("sign", [1, -1])
def test_case(spark, name, sign):
    bars, more, reason, r = CASES[name]
    if sign < 0:
        bars = [(200 - lo, 200 - hi, 200 - c) for hi, lo, c in bars]
    b, s = frames(spark, bars, [signal(sign, **more)])
    t = X.simulate(s, b, capital=1000.0, risk=0.01).collect()
    assert len(t) == 1 and t[0].reason == reason and t[0].pnl == pytest.approx(10 * r, abs=1e-6)


def test_costs(spark):
    b, s = frames(spark, [(103, 97, 98)], [signal()])
    for costs in ({"slippage": 0.05}, {"spread": 0.05}):
        assert X.simulate(s, b, capital=1000.0, **costs).first().pnl == pytest.approx(-10.25)


def test_blocked_signals(spark):
    flat = [(101, 99, 100)] * 2
    b, s = frames(spark, [*flat, (104, 99, 103), *flat], [signal(), signal(bar=2), signal(bar=3)])
    assert [t.bar for t in X.simulate(s, b, capital=1000.0).collect()] == [0]
    b, s = frames(spark, [*flat, (104, 99, 103), *flat], [signal(), signal(bar=3)])
    assert sorted(t.bar for t in X.simulate(s, b, capital=1000.0).collect()) == [0, 3]
    b, s = frames(spark, flat, [signal(), signal(seq=1)])
    assert [t.seq for t in X.simulate(s, b, capital=1000.0).collect()] == [0]


def test_grid_slots(spark):
    b, s = frames(spark, [(101, 99, 100)] * 2, [signal(seq=k) for k in range(3)])
    assert sorted(t.seq for t in X.simulate(s, b, capital=1000.0, slots=2).collect()) == [0, 1]


def test_relational_form_is_the_kernel(spark, data):
    from tidebar.plans import research

    cols = ["sym", "bar", "direction", "exit_bar", "reason", "equity"]
    key = lambda df: sorted((*r[:5], round(r[5], 2)) for r in df.select(*cols).collect())
    assert key(research.basic_trades(spark, data)) == key(research.relational_trades(spark, data))
