"""The grid search simulates all 81 possible trials, and trailing counts in their results."""

from tidebar.operators import filters as P
from tidebar.operators import validation as V
from tidebar.plans import catalog
from tidebar.plans.research import SPACE


def test_every_possible_trial(spark, data):
    trials = {r.trial: r for r in P.possible(V.grid(spark, SPACE)).collect()}
    found = {r.trial: r[1:] for r in catalog.QUERIES["x01_grid_search"](spark, data).collect()}
    assert len(trials) == 81 and set(found) == set(trials)
    alike = {}
    for trial, x in trials.items():
        alike.setdefault((x.channel_period, x.sl_atr_mult, x.tp_rr_ratio), []).append(((x.trail_start, x.trail_step), found[trial]))
    for trail in ((10, 5), (20, 5), (20, 15)):
        assert all(trail in dict(v) for v in alike.values())
    # each two ways of trailing give different results for some trial
    for a, b in (((10, 5), (20, 5)), ((20, 5), (20, 15)), ((10, 5), (20, 15))):
        assert any(dict(v)[a] != dict(v)[b] for v in alike.values())
