"""Resampling answers for every instance, with the reference's 1000 iterations."""

from hashlib import md5

import numpy as np
import pytest

from tidebar.operators import validation as V
from tidebar.plans import catalog
from tidebar.sources import tables as S


@pytest.mark.parametrize("name", ["v07_shuffle", "v08_bootstrap", "v10_group_shuffle"])
def test_every_instance_and_iteration(spark, data, name):
    want = {r.instance for r in S.ledger(spark, data).select("instance").distinct().collect()}
    found = catalog.QUERIES[name](spark, data).groupBy("grp").agg({"iter": "count"}).collect()
    assert {r["grp"]: r["count(iter)"] for r in found} == dict.fromkeys(want, 1000)


def test_permutation_by_brute_force(spark, data):
    last = S.ledger(spark, data).agg({"instance": "max"}).first()[0]
    pnl = np.array([r.pnl for r in S.ledger(spark, data).filter(f"instance = {last}").orderBy("exit_time", "trade_id", "leg").collect()])
    draws = np.array([[int(md5(f"p54321-{i}-{last}-{n}".encode()).hexdigest()[:8], 16) for n in range(len(pnl))] for i in range(1000)])
    score = lambda x: x.mean(-1) / x.std(-1, ddof=1)
    share = (score(np.where(draws % 2 == 0, pnl, -pnl)) >= score(pnl)).mean()
    assert last > 5
    assert [r.p_value for r in catalog.QUERIES["v09_permutation"](spark, data).filter(f"grp = {last}").collect()] == [pytest.approx(share)]


def test_distribution_of_every_instance(spark, data):
    want = {r.instance for r in S.ledger(spark, data).select("instance").distinct().collect()}
    assert {r.grp for r in catalog.QUERIES["v11_distribution"](spark, data).select("grp").collect()} == want


@pytest.mark.parametrize("f", [lambda t: V.shuffled(t, 30, 50.0), lambda t: V.bootstrapped(t, 30), lambda t: V.permutation(t, 30)])
def test_large_groups_make_a_row_a_draw(spark, monkeypatch, f):
    """Groups above the bound get the same numbers by another way."""
    rng = np.random.default_rng(1)
    rows = [(g, n, float(x)) for g, size in ((1, 90), (2, 7), (3, 1), (4, 2)) for n, x in enumerate(rng.integers(-9, 10, size))]
    trades = spark.createDataFrame(rows, "grp int, n long, pnl double")
    plain = lambda df: sorted(tuple(None if x is None else round(x, 9) for x in r) for r in df.collect())
    whole = plain(f(trades))
    monkeypatch.setattr(V, "HELD", 6)
    assert plain(f(trades)) == whole
    assert f(trades.limit(0)).count() == 0
