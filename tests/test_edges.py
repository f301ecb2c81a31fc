"""Values at the edges of what the queries' SQL says, on small tables of their own."""

import random
from datetime import datetime, timedelta

import pytest
from .compare import assert_same, connect

from tidebar.plans import catalog


@pytest.fixture
def tables(spark, data, tmp_path):
    """Puts rows in place of a table of the test data; the others stay."""

    def put(**given):
        for name, (rows, schema) in given.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con = connect(data)
        for name in given:
            con.execute(f"create or replace view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
        return str(tmp_path), con

    return put


def test_sessions_end_after_two_hours_to_the_microsecond(spark, tables):
    at, rows = datetime(2024, 1, 1), []
    for user, gap in enumerate((7199.999999, 7200.0, 7200.000001, 7200.5, 7201.0, 7201.000001)):
        rows += [(user, at, user), (user, at + timedelta(seconds=gap), user)]
    d, con = tables(events=([(n, ts, user) for n, (_, ts, user) in enumerate(rows)], "event_id long, ts timestamp_ntz, user_id long"))
    df = catalog.QUERIES["session_gaps"](spark, d)
    assert df.count() == 10
    assert_same(df, catalog.ORACLES["session_gaps"], con)


def _copies(days: int) -> dict:
    """Three suppliers with the same 40 amounts in different orders, so their sums tie but for what adding doubles makes of them."""
    rng, line, orders = random.Random(7), [], []
    amounts = [(rng.randrange(10**4, 10**9) / 100, rng.randrange(11) / 100, rng.randrange(9) / 100) for _ in range(40)]
    for supplier in (3, 1, 2):
        for price, discount, tax in rng.sample(amounts, 40):
            at = datetime(1997, 12, 1) + timedelta(days=days * (int(price) % 2))
            orders.append((len(line), at, "2-HIGH"))
            line.append((len(line), 1, supplier, "A", "O", at, price, discount, tax))
    kinds = "l_orderkey long, l_linenumber int, l_suppkey long, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz, l_extendedprice double, l_discount double, l_tax double"
    return {"lineitem": (line, kinds), "orders": (orders, "o_orderkey long, o_orderdate timestamp_ntz, o_orderpriority string")}


def test_equal_sums_rank_by_instance(spark, tables):
    d, _ = tables(**_copies(0))
    assert [(r.instance, r["rank"]) for r in catalog.QUERIES["w01_rank_by_score"](spark, d).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3)]


def test_equal_means_rank_by_trial(spark, tables):
    d, _ = tables(**_copies(60))
    found = catalog.QUERIES["x06_combined_rank"](spark, d).orderBy("trial").collect()
    assert [(r.trial, r.back_rank, r.forward_rank) for r in found] == [(1, 1, 1), (2, 2, 2), (3, 3, 3)]


def test_numbers_without_a_logarithm(spark, tables):
    values = [0.0, 0.0, -1.0, 0.25, 250.0, float("nan"), float("inf"), None]
    d, con = tables(events=(list(enumerate(values)), "event_id long, value double"))
    assert [r.log for r in catalog.QUERIES["f13_numbers"](spark, d).orderBy("event_id").collect()][:2] == [float("-inf")] * 2
    assert_same(catalog.QUERIES["f13_numbers"](spark, d), catalog.ORACLES["f13_numbers"], con)


def test_numbers_at_rounding_edges(spark, tables, data):
    """Roots whose seventh digit is a half but for the last bit of the double, of either sign of that bit, and numbers too large to have digits."""
    near = [(n + 0.5) * 1e-6 for n in range(3_000_000_000, 3_000_000_400)]
    values = [x * x for x in near] + [1e31, 1e300, 1.7e308, 1e-300, 5e-7, 2.5e-13, 250.0000005]
    d, con = tables(events=(list(enumerate(values)), "event_id long, value double"))
    df, sql = catalog.QUERIES["f13_numbers"](spark, d), catalog.ORACLES["f13_numbers"]
    con.execute(f"create temp table want as {sql}")
    want = dict(con.execute("select event_id, root from want").fetchall())
    assert {r.event_id: r.root for r in df.collect()} == want
    assert_same(df, sql, con)


def test_formats_of_odd_balances(spark, tables):
    balances = [-0.0, 0.0, -0.04, 0.96, 1e20, float("nan"), float("inf"), float("-inf"), None, 1234.56]
    rows = [(n * 99_999 - 12, None if n == 3 else "A", x) for n, x in enumerate(balances)] + [(None, "B", 1.0)]
    d, con = tables(customer=(rows, "c_custkey long, c_mktsegment string, c_acctbal double"))
    assert_same(catalog.QUERIES["f04_formatting"](spark, d), catalog.ORACLES["f04_formatting"], con)


def test_labels_of_odd_balances(spark, tables, data):
    few = {t: ([tuple(r) for r in spark.read.parquet(f"{data}/{t}.parquet").collect()], spark.read.parquet(f"{data}/{t}.parquet").schema) for t in ("nation", "region")}
    rows = [(n, "Supplier#1", n, x) for n, x in enumerate((-0.0, 0.0, -0.5, None, 7.9))]
    d, con = tables(supplier=(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"), **few)
    assert_same(catalog.QUERIES["q09_instance_labels"](spark, d), catalog.ORACLES["q09_instance_labels"], con)
