"""Digests on arrays against the library's."""

from hashlib import md5

import numpy as np
import pytest

from tidebar.operators import draws as D
from tidebar.operators import validation as V


@pytest.mark.parametrize("front, names", [("s42-{}-7-", range(1200)), ("b12345-{}-" + "9" * 18 + "-", [0, 9, 10, 19_999]), ("p-{}-" + "x" * 47 + "-", [5, 10]), ("é{}-" + "y" * 70, [1])])
def test_first_words_of_digests(monkeypatch, front, names):
    fronts, names = [front.format(i).encode() for i in range(10, 40)], [str(n).encode() for n in names]
    want = np.array([[int(md5(f + n).hexdigest()[:8], 16) for n in names] for f in fronts])
    for at_once in (16_384, 50):
        monkeypatch.setattr(D, "AT_ONCE", at_once)
        assert (D.draws(fronts, names) == want).all()


def test_draws_of_a_distribution_are_made_once(spark):
    trades = spark.createDataFrame([(g, n, float(n * n % 7 - 2)) for g in range(3) for n in range(20)], "grp int, n long, pnl double")
    df = V.distribution(V.bootstrapped(trades, 40), "sharpe", ["grp"])
    assert df.count() == 3
    assert df._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 1


def test_blocks_are_bounded_and_whole(monkeypatch):
    """Draws come some fronts at a time, so what is made of them stays in a cache; one front is never cut."""
    monkeypatch.setattr(D, "AT_ONCE", 100)
    fronts = [f"s42-{i}-7-".encode() for i in range(10, 50)]
    for size, rows in ((30, 3), (250, 1), (1, 40)):
        names = [str(n).encode() for n in range(size)]
        shapes = [b.shape for b in D.blocks(fronts, names)]
        assert sum(r for r, _ in shapes) == 40 and {c for _, c in shapes} == {size} and max(r for r, _ in shapes) == rows


def test_flips_that_add_up_to_nothing_reach_the_own_score(spark):
    """Sums are of whole cents: 0.1 + 0.2 flipped against 0.3 tie, which sums of doubles may miss."""
    cents = [30, -10, -20, 70, -10, -60, 110, 5]
    trades = spark.createDataFrame([(7, n, c / 100) for n, c in enumerate(cents)], "grp int, n long, pnl double")
    flips = [sum(c for n, c in enumerate(cents) if md5(f"p1-{i}-7-{n}".encode()).digest()[3] % 2) for i in range(400)]
    assert 0 in flips
    assert [r.p_value for r in V.permutation(trades, 400, 1).collect()] == [sum(x <= 0 for x in flips) / 400]


def test_samples_of_one_trade_have_no_score(spark):
    """Equal amounts have exactly no deviation, whatever their size; a lost cent is not more than a cent."""
    trades = spark.createDataFrame([(1, 0, 33.33), (1, 1, 33.33), (1, 2, 33.33), (2, 0, 0.07), (2, 1, -0.01)], "grp int, n long, pnl double")
    found = V.bootstrapped(trades, 300).collect()
    assert {(r.sharpe, r.profit_factor) for r in found if r.grp == 1} == {(0.0, 100.0)}
    assert {r.profit_factor for r in found if r.grp == 2} == {100.0, 0.0}


def test_trades_meet_their_iterations_once(spark):
    """A trade is joined to the list of large groups alone, not to the size of its group."""
    trades = spark.createDataFrame([(g, n, float(n)) for g in range(3) for n in range(20)], "grp int, n long, pnl double")
    df = V.bootstrapped(trades, 1000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    held = plan[plan.index("FlatMapGroupsInArrow") : plan.index("LeftAnti, BuildRight")]
    assert "SortMergeJoin" not in held and "Generate" not in held
    assert df.groupBy("grp").count().filter("count != 1000").count() == 0


def test_values_of_a_distribution_are_shuffled_once(spark):
    """Each value goes to its key once, not once for each percentile."""
    values = spark.createDataFrame([(k, float(v)) for k in range(2) for v in [5, -1, 3, 3, 8 + k, 20]] + [(2, 4.0), (3, None)], "k int, v double")
    df = V.distribution(values, "v", ["k"])
    assert df._jdf.queryExecution().optimizedPlan().toString().count("collect_list") == 1 and "percentile(" not in df._jdf.queryExecution().optimizedPlan().toString()
    found = {r.k: r for r in df.collect()}
    for k, own in ((0, [5, -1, 3, 3, 8, 20]), (1, [5, -1, 3, 3, 9, 20]), (2, [4])):
        assert [found[k][f"p{q}"] for q in (5, 25, 50, 75, 95)] == pytest.approx(list(np.percentile(own, [5, 25, 50, 75, 95])))
        assert found[k].shortfall == min(own) and found[k].above5 == pytest.approx(np.mean(np.array(own) > 5))
    assert set(found) == {0, 1, 2}
