"""Generated scenario banks and rule-based baseline advisors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import audit as a

RUNS_PER_SCENARIO = 5

# Universe, fact ids and advisor labels of the bank.
UNIVERSE = ("MA", "ADBE", "ANET", "NVO", "TSM", "ASML", "MSFT", "GOOGL")
FACT_IDS = (
    "em_equity_2025_return_34_4pct",
    "developed_international_2025_return_31_9pct",
    "asset_allocation_2025_return_15_8pct",
    "us_aggregate_2025_return_7_3pct",
    "mag7_sp500_return_share_2025_46pct",
    "sp500_all_time_highs_2025_39",
    "us_gdp_3q25_annualized_4_3pct",
    "unemployment_nov2025_4_6pct",
    "fed_funds_dec2025_3_63pct",
)
ADVISORS = (
    "deterministic_contract",
    "agreement_only_splitter",
    "unstable_selector",
    "fact_hallucinator",
    "cash_overrun",
)
# Category -> (cash level, allowed, owned, policy, facts, limits).
# Lists are slices (start, length) of the variant's rotated universe or facts.
LARGE, SUBTRANCHE, SMALL = "1250 + v * 25", "900 + v * 10", "180 + v * 5"
CATEGORIES = {
    "new_cash_deployment": dict(cash=LARGE, policy=3, amounts=True),
    "subtranche_cash": dict(cash=SUBTRANCHE, policy=1, limit=2, add_only=False, amounts=True),
    "already_owned_asset": dict(cash=LARGE, policy=3, owns_policy=True),
    "fee_sensitive_order": dict(cash=SUBTRANCHE, policy=1, limit=2, amounts=True),
    "insufficient_cash": dict(cash=SMALL, policy=0, limit=1, amounts=True),
    "out_of_universe_ticker": dict(cash=LARGE, policy=2, allowed=5),
    "hallucinated_fact": dict(cash=LARGE, policy=2, facts="slice(facts, 1, 3)"),
    "stale_market_fact": dict(cash=LARGE, policy=2, facts="slice(facts, 4, 3)"),
    "drawdown_case": dict(cash=LARGE, policy=2, facts="slice(facts, 7, 2)"),
    "rebalance_versus_hold": dict(cash=LARGE, policy=1, limit=1, amounts=True, fraction=0.95),
    "fractional_share_unavailable": dict(cash=LARGE, policy=1, limit=1, amounts=True, fraction=0.90),
    "conflicting_rationale": dict(cash=LARGE, policy=2, facts="array(facts[0], facts[8])"),
}


def strings(values) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def rotate(values: str, by: str) -> str:
    """Move the first ``by`` items to the end (``by`` may exceed the length)."""
    size = f"size({values})"
    cut = f"int(pmod({by}, greatest({size}, 1)))"
    return f"concat(slice({values}, {cut} + 1, greatest({size} - {cut}, 0)), slice({values}, 1, {cut}))"


def scenario_bank(variants: DataFrame) -> DataFrame:
    """Twelve scenarios per variant number (column ``v``), for any number of variants."""
    base = variants.selectExpr(
        "v", "if(v < 999, lpad(v + 1, 3, '0'), string(v + 1)) AS suffix",
        f"{rotate(strings(UNIVERSE), 'v')} AS base", f"{rotate(strings(FACT_IDS), 'v')} AS facts",
    )
    none = "cast(array() AS array<string>)"
    cells = []
    for category, k in CATEGORIES.items():
        owned = "slice(base, 5, 2)"
        if k.get("owns_policy"):
            owned = f"concat(slice(base, 1, 1), {owned})"
        fraction = f"{k['fraction']}D" if "fraction" in k else "cast(NULL AS double)"
        cells.append(
            f"struct('{category}' AS category, double({k['cash']}) AS cash, "
            f"slice(base, 1, {k.get('allowed', 8)}) AS allowed_tickers, {owned} AS owned_tickers, "
            f"slice(base, 1, {k['policy']}) AS policy_tickers, {k.get('facts', none)} AS available_fact_ids, "
            f"{k.get('limit', 3)} AS max_recommendations, {str(k.get('add_only', True)).lower()} AS add_only, "
            f"{str(k.get('amounts', False)).lower()} AS amounts_required, "
            f"{fraction} AS min_cash_deployment_fraction)"
        )
    return base.selectExpr("v", "suffix", f"inline(array({', '.join(cells)}))").selectExpr(
        "concat(category, '_', suffix) AS scenario", "category", "cash", "allowed_tickers", "owned_tickers",
        "policy_tickers", f"{none} AS restricted_tickers", f"{none} AS concentration_blocked_tickers",
        "available_fact_ids", "max_recommendations", "add_only", "amounts_required",
        "250D AS min_order_amount", "min_cash_deployment_fraction",
    )


# Adversarial pools, and per family the cash levels, offsets into the pool,
# recommendation limit and flags.
HELD_POOL = (
    "AAPL", "MSFT", "GOOGL", "AMZN", "META", "NVDA", "AVGO", "JPM",
    "UNH", "LLY", "V", "MA", "COST", "HD", "PG", "XOM", "JNJ",
)
FRESH_POOL = ("ASML", "TSM", "NVO", "SAP", "TM", "SHEL", "RY", "BHP", "SNY", "UL")
FAMILIES = {
    "fee_split": ("unnecessary_split_fee", (900, 700, 950, 800), (0, 1), 2, False, True),
    "below_floor": ("below_min_order", (400, 450, 480, 420), (0, 2), 2, False, True),
    "cash_overrun": ("cash_exceeded", (1480, 2300, 1999, 2100), (0, 1, 2), 3, False, True),
    "already_owned": ("already_owned", (1500, 1200, 900, 1800), (0,), 2, True, False),
    "too_many": ("too_many_recommendations", (1500, 2000, 1200, 1700), (0, 1, 2, 3, 4), 2, False, False),
    "unsupported_fact": ("unsupported_fact", (1500, 1300, 1100, 1600), (0, 3), 2, False, False),
}


def adversarial_bank(indexes: DataFrame) -> DataFrame:
    """Six families per index (column ``i``); cash levels repeat every four indexes."""
    cells = []
    for family, (category, cash, offsets, limit, add_only, amounts) in FAMILIES.items():
        fresh = ", ".join(f"fresh[int(pmod(i + {o}, {len(FRESH_POOL)}))]" for o in offsets)
        pool = f"array({fresh})"
        if family == "already_owned":
            pool = f"array(held[int(pmod(i, {len(HELD_POOL)}))], {fresh})"
        facts = "cast(array() AS array<string>)"
        if family == "unsupported_fact":
            facts = "array(concat('market_fact_', i))"
        levels = ", ".join(f"{c}D" for c in cash)
        cells.append(
            f"struct(concat('{family}_', i) AS scenario, '{category}' AS category, "
            f"array({levels})[int(i % 4)] AS cash, {pool} AS allowed_tickers, held AS owned_tickers, "
            f"{facts} AS available_fact_ids, {limit} AS max_recommendations, "
            f"{str(add_only).lower()} AS add_only, {str(amounts).lower()} AS amounts_required)"
        )
    pools = indexes.selectExpr("i", f"{strings(FRESH_POOL)} AS fresh", f"{strings(HELD_POOL)} AS held")
    return pools.selectExpr(f"inline(array({', '.join(cells)}))")


def baseline_runs(scenarios: DataFrame, runs: int = RUNS_PER_SCENARIO) -> DataFrame:
    """Recommendations of five rule-based advisors for every scenario."""
    none, no_amounts = "cast(array() AS array<string>)", "cast(array() AS array<double>)"
    base = scenarios.selectExpr(
        "*",
        f"{a.normalize_tickers('allowed_tickers')} AS allowed",
        f"{a.normalize_tickers('owned_tickers')} AS owned",
        f"{a.normalize_tickers('policy_tickers')} AS wanted",
    ).selectExpr(
        "*", "slice(if(add_only, array_except(wanted, owned), wanted), 1, max_recommendations) AS policy"
    ).selectExpr(
        "*", "if(size(policy) > 0, policy, slice(allowed, 1, 1)) AS fallback",
        f"explode(sequence(1, {runs})) AS run",
    )
    valid = f"if(amounts_required AND size({{t}}) > 0 AND cash >= min_order_amount, array(bround(cash, 2)), {no_amounts})"
    first_if_sized = "if(amounts_required, slice({t}, 1, 1), {t})"
    contract = first_if_sized.format(t="policy")
    liar = first_if_sized.format(t="fallback")
    second = "coalesce(get(filter(allowed, x -> NOT array_contains(slice(fallback, 1, 1), x)), 0), allowed[0])"
    pair = (
        "CASE WHEN size(fallback) >= 2 THEN slice(fallback, 1, 2) "
        f"WHEN size(allowed_tickers) > 1 THEN array(fallback[0], {second}) ELSE slice(fallback, 1, 1) END"
    )
    split = f"if(amounts_required AND size(fallback) > 0, {pair}, fallback)"
    split_amounts = (
        "if(amounts_required AND size(fallback) > 0, "
        f"transform({pair}, x -> bround(cash / size({pair}), 2)), {no_amounts})"
    )
    turn = f"slice({rotate('allowed', 'run - 1')}, 1, max_recommendations)"
    roaming = f"if(add_only, filter({turn}, x -> NOT array_contains(owned_tickers, x)), {turn})"
    roaming_amounts = valid.format(t=f"if(amounts_required, slice({roaming}, 1, 1), {roaming})")
    roaming_picks = f"if(size({roaming_amounts}) > 0, slice({roaming}, 1, size({roaming_amounts})), {roaming})"
    over = f"if(amounts_required AND size(fallback) > 0, array(bround(cash + 100 + run, 2)), {no_amounts})"
    one_fact = "slice(available_fact_ids, 1, 1)"
    made_up = f"concat({one_fact}, array(concat('unsupported_live_fact_', run)))"
    plans = {
        "deterministic_contract": (contract, valid.format(t=contract), one_fact),
        "agreement_only_splitter": (split, split_amounts, one_fact),
        "unstable_selector": (roaming_picks, roaming_amounts, none),
        "fact_hallucinator": (liar, valid.format(t=liar), made_up),
        "cash_overrun": ("slice(fallback, 1, 1)", over, none),
    }
    cells = ", ".join(
        f"struct('{name}' AS advisor, {picks} AS tickers, {amounts} AS amounts, {facts} AS cited_fact_ids)"
        for name, (picks, amounts, facts) in plans.items()
    )
    return base.selectExpr("scenario", "concat('run_', run) AS run_id", f"inline(array({cells}))")
