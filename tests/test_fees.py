import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from holdfast.functions import fees as fee


def column(spark, sql, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).selectExpr(f"{sql} AS x").collect()]


def test_fee_tiers(spark):
    amounts = [0.0, -5.0, 500.0, 1000.0, 1000.01, 1500.0, 2000.0, 2001.0]
    got = column(spark, fee.order_fee("a"), [(a,) for a in amounts], "a double")
    assert got == [0.0, 0.0, 2.5, 2.5, 5.0, 5.0, 5.0, 7.5]
    assert fee.DEFAULT_FEES.floor == 250.0


def test_naive_split_at_800_pays_twice(spark):
    assert column(spark, fee.two_way_fee("a", "0.6D"), [(800.0,)], "a double") == [5.0]


def sizes(spark, cases):
    return column(spark, fee.order_amounts("s", "c"), cases, "s array<double>, c double")


def test_known_plans(spark):
    scores = [90.0, 85.0, 80.0, 75.0, 70.0, 65.0]
    got = sizes(spark, [(scores, 100000.0), (scores[:2], 1500.0), (scores[:2], 800.0), (scores[:2], 240.0), ([], 900.0)])
    assert len(got[0]) == 6 and sum(got[0]) == 100000.0
    assert len(got[1]) == 2 and sum(got[1]) == 1500.0 and got[1][0] > got[1][1]
    assert got[2] == [800.0] and got[3] == [] and got[4] == []


def test_cash_grid_invariants(spark):
    """Never more fee than one order, never below the floor, all cash placed."""
    sets = [[60.0, 40.0], [90.0, 80.0, 70.0], [99.0, 1.0, 1.0, 1.0], [0.0, 0.0, 0.0], [50.0] * 6, [88.0]]
    cases = [(s, float(c)) for s in sets for c in range(0, 9001, 35)]
    one = lambda a: 0.0 if a <= 0 else math.ceil(a / 1000) * 2.5
    for (scores, cash), legs in zip(cases, sizes(spark, cases)):
        if cash < 250:
            assert legs == []
            continue
        assert abs(sum(legs) - cash) < 1e-6
        assert all(leg >= 250 - 1e-9 for leg in legs)
        assert sum(one(leg) for leg in legs) <= one(round(sum(legs), 6)) + 1e-9
        assert len(legs) <= min(6, len(scores))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(1, 100), min_size=3, max_size=6), st.integers(3000, 40000))
def test_tranche_legs_are_whole_but_one(spark, scores, cash):
    legs = column(spark, fee.tranche_amounts("s", "c"), [(scores, float(cash))], "s array<double>, c double")[0]
    if legs:
        assert sum(legs) == pytest.approx(cash)
        assert sum(1 for leg in legs if leg % 1000) <= 1


def test_floor_rejects_bad_inputs(spark):
    got = column(spark, fee.economic_floor("c", "t"), [(2.5, 0.01), (-1.0, 0.01), (2.5, 0.0)], "c double, t double")
    assert got == [250.0, None, None]


def test_guardrails_and_tranche_invariance(spark):
    rows = spark.createDataFrame([(float(c),) for c in (0, 249.99, 250, 500, 1000, 1000.01, 2500)], "cash double")
    got = {r.cash: r for r in rows.selectExpr("cash", *[f"{sql} AS {name}" for name, sql in fee.guardrails("cash").items()]).collect()}
    assert {r.min_order for r in got.values()} == {250.0}
    assert [c for c, r in got.items() if r.first_order] == [250, 500, 1000, 1000.01, 2500]
    assert [c for c, r in got.items() if r.second_order] == [500, 1000, 1000.01, 2500]
    assert all(r.split_premium == 0 for r in got.values())
    assert got[2500].boundary == 1000 and got[500].boundary == 500
