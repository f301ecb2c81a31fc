"""Shares of variance against plain sums."""

import random
from itertools import combinations

import pytest

from tidebar.operators.importance import importance


def test_shares(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(500):
        a, b, c = rng.choice("xyz"), rng.choice(["p", "q", None]), rng.randrange(2)
        rows.append((a, b, c, {"x": 0, "y": 3, "z": -1}[a] + (5 if b is None and c else 0) + rng.random()))
    rows += [("x", "p", 1, None)] * 20
    got = {(r.first, r.second): (r.cells, r.share) for r in importance(spark.createDataFrame(rows, "a string, b string, c int, s double"), ["a", "b", "c"], "s").collect()}
    kept = [r for r in rows if r[3] is not None]
    mean = sum(r[3] for r in kept) / len(kept)
    total = sum((r[3] - mean) ** 2 for r in kept)

    def average(places, r):
        like = [q[3] for q in kept if all(q[i] == r[i] for i in places)]
        return sum(like) / len(like) - mean

    want = {}
    for i in range(3):
        want["abc"[i], None] = len({r[i] for r in kept}), sum(average([i], r) ** 2 for r in kept) / total
    for i, j in combinations(range(3), 2):
        effect = [average([i, j], r) - average([i], r) - average([j], r) for r in kept]
        want["abc"[i], "abc"[j]] = len({(r[i], r[j]) for r in kept}), sum(e * e for e in effect) / total
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1])
    assert want["a", None][1] > 0.3 and want["b", "c"][1] > 0.1


def test_no_variance_and_no_rows(spark):
    same = spark.createDataFrame([("x", "p", 1.0), ("y", "p", 1.0)], "a string, b string, s double")
    assert all(r.share is None for r in importance(same, ["a", "b"], "s").collect())
    assert importance(same.limit(0), ["a", "b"], "s").count() == 0
