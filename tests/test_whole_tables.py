"""Queries that once kept a range of ids answer for the whole table."""

import math

import pytest

from tidebar.plans import catalog
from tidebar.sources import tables as S


def test_continued_equity_of_every_instance(spark, data):
    trades = sorted((r.instance, r.exit_time.year >= 1998, r.exit_time, r.trade_id, r.leg, r.pnl) for r in S.ledger(spark, data).collect())
    want, equity = {}, {}
    for instance, _, _, trade, leg, pnl in trades:
        equity[instance] = equity.get(instance, 3000.0) + pnl
        want[trade, leg] = equity[instance]
    found = {(r.trade_id, r.leg): r.equity for r in catalog.QUERIES["w17_continued_equity"](spark, data).collect()}
    assert found == pytest.approx(want, abs=0.006)


def test_lines_of_every_event(spark, data):
    want = {r.event_id: str(math.floor(r.value + 0.5)) for r in S.read(spark, data, "events").collect()}
    assert {r.event_id: r.score for r in catalog.QUERIES["f03_labelled_lines"](spark, data).collect()} == want


def test_arrays_of_every_trade(spark, data):
    legs = {}
    for r in S.ledger(spark, data).collect():
        legs.setdefault(r.trade_id, []).append((r.leg, r.pnl))
    found = {r.trade_id: r for r in catalog.QUERIES["f15_arrays"](spark, data).collect()}
    assert {k: (r.n, r.first_pnl) for k, r in found.items()} == {k: (len(v), pytest.approx(min(v)[1], abs=0.006)) for k, v in legs.items()}
    assert {k: r.gain or 0.0 for k, r in found.items()} == pytest.approx({k: sum(p for _, p in v if p > 0) for k, v in legs.items()}, abs=0.006)
