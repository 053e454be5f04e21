import numpy as np
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from holdfast.functions import audit as a
from holdfast.operators import audit as o

SCENARIO = (
    "scenario string, cash double, allowed_tickers array<string>, owned_tickers array<string>, "
    "policy_tickers array<string>, restricted_tickers array<string>, concentration_blocked_tickers array<string>, "
    "available_fact_ids array<string>, max_recommendations int, add_only boolean, amounts_required boolean, "
    "min_order_amount double, min_cash_deployment_fraction double"
)
RUN = "scenario string, advisor string, run_id string, tickers array<string>, amounts array<double>, cited_fact_ids array<string>"


def scenario(**over):
    base = dict(
        scenario="s", cash=1500.0, allowed=["A", "B", "C"], owned=["C"], policy=["A", "B"], restricted=[], blocked=[],
        facts=["f1"], limit=3, add_only=True, required=False, floor=250.0, fraction=None,
    )
    base.update(over)
    return tuple(base.values())


def verdict(spark, run, **over):
    runs = spark.createDataFrame([("s", "x", "r", *run)], RUN)
    row = o.run_verdicts(runs, spark.createDataFrame([scenario(**over)], SCENARIO)).head()
    return row


@pytest.mark.parametrize(
    "run, over, expected",
    [
        ((["a", " B "], [], []), {}, []),
        ((["A", "Z"], [], []), {}, ["ticker_not_allowed:Z"]),
        ((["C"], [], []), {}, ["already_owned:C"]),
        ((["C"], [], []), {"add_only": False}, []),
        ((["A"], [], []), {"restricted": ["a"]}, ["restricted_ticker:A"]),
        ((["A"], [], []), {"blocked": ["A"]}, ["concentration_breach:A"]),
        ((["A", "B"], [], []), {"limit": 1}, ["too_many_recommendations"]),
        ((["A"], [], []), {"required": True}, ["amounts_required"]),
        (([], [], []), {"required": True, "cash": 100.0}, []),
        ((["A", "A"], [500.0, 500.0], []), {}, ["amount_count_mismatch"]),
        ((["A"], [float("nan")], []), {}, ["non_finite_amount"]),
        ((["A"], [1500.02], []), {}, ["cash_exceeded"]),
        ((["A"], [1500.0], []), {}, []),
        ((["A"], [100.0], []), {}, ["below_min_order:A"]),
        ((["A"], [-1.0], []), {}, ["non_positive_order:A"]),
        ((["A", "B"], [600.0, 300.0], []), {"cash": 900.0}, ["unnecessary_split_fee"]),
        ((["A"], [800.0], []), {"fraction": 0.9}, ["cash_underdeployed"]),
        ((["A"], [], ["f1", "zz", "zz"]), {}, ["unsupported_fact:zz", "unsupported_fact:zz"]),
    ],
)
def test_rules(spark, run, over, expected):
    assert verdict(spark, run, **over).violations == expected


def test_policy_comparison(spark):
    row = verdict(spark, (["B", "Z", "A"], [], []))
    assert (row.overlap_at_k, row.agreement_at_k) == (1, 0.5)
    assert row.policy_jaccard == pytest.approx(1 / 3)
    assert row.missing_policy == ["A"] and row.extra_tickers == ["Z"]
    empty = verdict(spark, ([], [], []), policy=[])
    assert empty.agreement_at_k == 1.0 and empty.policy_jaccard == 1.0


def test_failure_classes(spark):
    rows = spark.createDataFrame(
        [("ticker_not_allowed:A",), ("cash_exceeded",), ("restricted_ticker:B",), ("amounts_required",)], "v string"
    )
    got = [r[0] for r in rows.selectExpr(f"{a.violation_class('v')} AS x").collect()]
    assert got == ["out_of_universe", "cash_overrun", "restricted_ticker:B", "malformed_amounts"]


def sample_runs(spark, seed, groups):
    rng = random.Random(seed)
    names = [f"T{i}" for i in range(20)]
    rows = []
    for group, count, widest in groups:
        for i in range(count):
            picks = rng.sample(names, rng.randint(0, widest))
            amounts = [float(rng.randint(1, 9) * 100) for _ in picks] if rng.random() < 0.8 else []
            rows.append((group, "x", f"{group}-{i}", picks, amounts, []))
    return spark.createDataFrame(rows, RUN), rows


def jaccard(x, y):
    x, y = set(x), set(y)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_set_stability_matches_pairs(spark):
    """One block and many; one group dominates."""
    runs, rows = sample_runs(spark, 3, [("hot", 60, 6), ("wide", 25, 17), ("one", 1, 3), ("few", 4, 4)])
    for limit in (64, 2):
        got = {r.scenario: r.set_stability for r in o.set_stability(runs, block=limit).collect()}
        for group in ("hot", "wide", "one", "few"):
            picks = [r[3] for r in rows if r[0] == group]
            pairs = [jaccard(x, y) for x, y in combinations(picks, 2)]
            assert got[group] == pytest.approx(sum(pairs) / len(pairs) if pairs else 1.0)


def test_amount_stability_matches_pairs(spark):
    runs, rows = sample_runs(spark, 5, [("hot", 40, 5), ("one", 1, 3), ("few", 5, 4)])
    got = {r.scenario: r.amount_stability for r in o.amount_stability(runs).collect()}
    for group in ("hot", "few"):
        vectors = []
        for r in rows:
            if r[0] == group and r[4]:
                total = sum(r[4])
                vectors.append({t: x / total for t, x in zip(r[3], r[4])})
        distances = [
            sum(abs(x.get(k, 0) - y.get(k, 0)) for k in set(x) | set(y)) / 2 for x, y in combinations(vectors, 2)
        ]
        assert got[group] == pytest.approx(1 - sum(distances) / len(distances))
    assert got.get("one") is None


def test_extra_rule_is_one_entry(spark):
    rules = {**a.RULES, "odd": lambda: a.flag("size(picks) = 1", "single_pick")}
    runs = spark.createDataFrame([("s", "x", "r", ["A"], [], [])], RUN)
    row = o.run_verdicts(runs, spark.createDataFrame([scenario()], SCENARIO), rules).head()
    assert row.violations == ["single_pick"] and not row.valid


def test_arm_helpers(spark):
    rows = spark.createDataFrame([("policy", 0.95), ("other", 0.7), ("bare", 0.2)], "arm string, r double")
    got = rows.select(o.arm_rank(F.col("arm")), o.rate_band(F.col("r"))).collect()
    assert [tuple(r) for r in got] == [(1, "ok"), (9, "warn"), (0, "bad")]


def test_codes_follow_the_picks(spark):
    runs = spark.createDataFrame([("s", "a", "1", [" z", "c", "Z", "y"], [], [])], "scenario string, advisor string, run_id string, tickers array<string>, amounts array<double>, cited_fact_ids array<string>")
    scen = spark.createDataFrame([("s", 100.0, ["c"], ["C"], [], ["Z"], ["z"], [], 2, True, False, 250.0, None)],
        "scenario string, cash double, allowed_tickers array<string>, owned_tickers array<string>, policy_tickers array<string>, restricted_tickers array<string>, "
        "concentration_blocked_tickers array<string>, available_fact_ids array<string>, max_recommendations int, add_only boolean, amounts_required boolean, "
        "min_order_amount double, min_cash_deployment_fraction double")
    row = o.run_verdicts(runs, scen).head()
    assert row.violations == ["too_many_recommendations", "ticker_not_allowed:Z", "restricted_ticker:Z", "concentration_breach:Z",
                              "already_owned:C", "ticker_not_allowed:Y"]
    with pytest.raises(Exception, match="unknown scenario: s"):
        o.run_verdicts(runs, scen.withColumn("scenario", F.lit("t"))).collect()


def test_set_stability_of_many_wide_sets(spark):
    """5,000 different sets of 20 tickers in one run set, in many block pairs."""
    rng = np.random.default_rng(3)
    holds = np.zeros((5000, 60), bool)
    for row in holds:
        row[rng.choice(60, 20, replace=False)] = True
    rows = [("s", "x", [f"T{i}" for i in np.flatnonzero(row)]) for row in holds]
    rows += [("s", "x", rows[0][2])] * 3 + [("t", "x", [])] * 2 + [("t", "x", ["A"]), ("u", "x", ["A"]), (None, "x", ["A"])]
    runs = spark.createDataFrame(rows, "scenario string, advisor string, tickers array<string>")
    got = {r.scenario: (r.runs, r.set_stability) for r in o.set_stability(runs).collect()}
    whole = np.concatenate([holds, np.repeat(holds[:1], 3, 0)]).astype(np.float32)
    shared = (whole @ whole.T)[np.triu_indices(len(whole), 1)]
    assert got["s"] == (5003, pytest.approx(float((shared / (40 - shared)).mean()), rel=1e-6))
    assert got["t"] == (3, pytest.approx(1 / 3)) and got["u"] == (1, 1.0) and len(got) == 3


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_block_size_does_not_change_the_counts(spark, block):
    rng = np.random.default_rng(block)
    rows = [("s", "x", [f"T{i}" for i in rng.choice(9, int(rng.integers(0, 6)), replace=False)]) for _ in range(40)]
    runs = spark.createDataFrame(rows, "scenario string, advisor string, tickers array<string>")
    sets = [set(r[2]) for r in rows]
    scores = [1.0 if not x | y else len(x & y) / len(x | y) for i, x in enumerate(sets) for y in sets[:i]]
    got = o.set_stability(runs, block=block).collect()
    assert [r.set_stability for r in got] == [pytest.approx(sum(scores) / len(scores))]
