import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from holdfast.operators import pit
from holdfast.operators import review as rv

HELD = "portfolio_id long, ticker string, theme string, weight_pct double, position_count long, composite_score double, valuation_points double, moat_points double, compounding_points double"


def held_rows(rng, portfolio, n):
    return [
        (portfolio, f"H{portfolio}_{i}", f"T{rng.randint(0, 4)}", 100 / n, n, round(rng.uniform(30, 80), 1), round(rng.uniform(20, 90), 1), 50.0, 50.0)
        for i in range(n)
    ]


def test_replacements_match_greedy_walk(spark):
    rng = random.Random(11)
    held = [row for p in range(8) for row in held_rows(rng, p, rng.randint(1, 14))]
    cands = [(f"C{i}", f"C{i}", f"T{i % 6}", round(rng.uniform(40, 95), 1), round(rng.uniform(10, 80), 1)) for i in range(9)]
    h = spark.createDataFrame(held, HELD)
    c = spark.createDataFrame(cands, "ticker string, name string, theme string, composite_score double, valuation_points double")
    got = {}
    for row in rv.replacements(h, rv.screen(h, c, 9)).orderBy("portfolio_id", "place").collect():
        got.setdefault(row.portfolio_id, []).append((row.current_ticker, row.candidate_ticker))
    ranked = sorted(cands, key=lambda x: (-x[3], x[0]))
    for p in range(8):
        picks, used = [], set()
        for row in sorted((x for x in held if x[0] == p), key=lambda x: (x[5], x[1])):
            match = next((x for x in ranked if x[0] not in used and x[3] - row[5] >= 8 and x[4] - row[6] >= -5), None)
            if match and len(picks) < 3:
                picks.append((row[1], match[0]))
                used.add(match[0])
        assert got.get(p, []) == picks


def test_screen_excludes_owned_and_fit_scores(spark):
    held = [(1, "AAA", "Platforms", 12.0, 3, 72.0, 60.0, 0.0, 0.0), (1, "BBB", "Platforms", 11.0, 3, 70.0, 60.0, 0.0, 0.0), (1, "CCC", "Healthcare", 5.0, 3, 68.0, 60.0, 0.0, 0.0)]
    cands = [("PLAT", "p", "Platforms", 90.0, 60.0), ("INDU", "i", "Industrial", 84.0, 60.0), ("HLTH", "h", "Healthcare", 82.0, 60.0), ("aaa", "owned", "Platforms", 99.0, 60.0)]
    h = spark.createDataFrame(held, HELD)
    c = spark.createDataFrame(cands, "ticker string, name string, theme string, composite_score double, valuation_points double")
    screened = rv.screen(h, c, 10)
    row = rv.fit_ranking(screened).head()
    assert (row.isolated_top, row.fit_top, row.ranking_changed) == ("PLAT", "INDU", True)
    adds = rv.additions(screened).orderBy("place").collect()
    assert [x.ticker for x in adds] == ["PLAT", "INDU", "HLTH"]
    assert adds[1].structural_role == "Diversifier" and adds[1].portfolio_fit_score == 92.0
    assert adds[0].reason.startswith("Portfolio is below")


def test_any_number_of_candidates(spark):
    many = spark.range(5000).selectExpr("concat('C', id) AS ticker", "'n' AS name", "'t' AS theme", "double(id) AS composite_score", "0D AS valuation_points")
    held = spark.createDataFrame([(1, f"c{i}", "t", 1.0, 300, 72.0, 60.0, 0.0, 0.0) for i in range(4700, 5000)], HELD)
    found = rv.screen(held, many, 10).head()
    assert [x.ticker for x in found.screened] == [f"C{i}" for i in range(4699, 4689, -1)]
    assert found.theme_weights == {"t": 300.0}


def test_ranks_of_one_large_even_group(spark):
    from holdfast.grouping import ranked_per_group

    rows = spark.range(20_000).selectExpr("1 AS g", "5D AS v", "lpad(id, 6, '0') AS t").union(spark.createDataFrame([(2, 1.0, "x")], "g int, v double, t string"))
    got = ranked_per_group(rows, ["g"], [F.col("v").desc(), F.col("t")]).collect()
    assert {(r.g, r.t): r["rank"] for r in got} == {(1, f"{i:06d}"): i + 1 for i in range(20_000)} | {(2, "x"): 1}


def test_perturbed_weights_sum_to_one():
    sets = rv.perturbed_sets()
    assert len(sets) == 12
    assert all(sum(w) == pytest.approx(1) for w in sets.values())


def facts_df(spark, rows):
    return spark.createDataFrame(
        rows, "entity string, tag string, period_end date, filed date, form string, fiscal_year int, value double, accession long"
    )


def test_filed_date_governs(spark):
    d = dt.date
    facts = facts_df(spark, [
        ("E", "Rev", d(2022, 12, 31), d(2023, 2, 15), "10-K", 2022, 1.0, 1),
        ("E", "Rev", d(2023, 3, 31), d(2023, 5, 1), "10-q", 2023, 2.0, 2),
        ("E", "Rev", d(2023, 12, 31), d(2024, 2, 20), "10-K", 2023, 3.0, 3),
    ])
    asks = spark.createDataFrame([("E", "Rev", d(2024, 1, 15)), ("E", "Rev", d(2024, 2, 20)), ("E", "Rev", d(2023, 1, 1))], "entity string, tag string, as_of date")
    got = {r.as_of: r.value for r in pit.latest_as_of(facts, asks).collect()}
    assert got == {d(2024, 1, 15): 2.0, d(2024, 2, 20): 3.0, d(2023, 1, 1): None}
    years = pit.annual_series_as_of(facts, "2024-01-15").collect()
    assert [(y.fiscal_year, y.value) for y in years] == [(2022, 1.0)]


def test_as_of_matches_brute_force(spark):
    rng = random.Random(2)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 300))
    facts = [("hot" if i % 3 else "E", "T", day(), day(), "10-K", 2020, float(i), i) for i in range(120)]
    asks = {(e, "T", day()) for e in ("hot", "E", "none") for _ in range(25)}
    got = {(r.entity, r.as_of): r.value for r in pit.latest_as_of(facts_df(spark, facts), spark.createDataFrame(list(asks), "entity string, tag string, as_of date")).collect()}
    for entity, _, as_of in asks:
        seen = [f for f in facts if f[0] == entity and f[3] <= as_of]
        best = max(seen, key=lambda f: (f[2], f[3], f[7], f[6])) if seen else None
        assert got[entity, as_of] == (best[6] if best else None)
