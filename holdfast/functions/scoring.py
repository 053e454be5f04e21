"""Moat, compounding and valuation scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame

from holdfast.functions import series as s

# Factor weights of the composite score.
COMPOSITE_WEIGHTS = {"moat": 0.40, "compounding": 0.35, "valuation": 0.25}


def peg(forward_pe: str, eps_cagr: str) -> str:
    return f"(CASE WHEN {eps_cagr} > 0 THEN nullif({forward_pe}, 0D) / ({eps_cagr} * 100) END)"


def fcf_yield(free_cash_flow: str, market_cap: str, rate: str) -> str:
    return f"(CASE WHEN {market_cap} > 0 THEN nullif({free_cash_flow}, 0D) * {rate} / {market_cap} END)"


def moat_class(is_financial: str, roic: str, roe: str, margin_cv: str, pricing_power: str) -> str:
    return f"""(CASE
        WHEN {is_financial} THEN if({roe} >= 0.15D, 'STRONG', 'MODERATE')
        WHEN {roic} IS NULL THEN 'INSUFFICIENT_DATA'
        WHEN {roic} >= 0.15D AND {margin_cv} <= 0.10D THEN if({pricing_power} >= 0.70D, 'STRONG', 'MODERATE')
        WHEN {roic} < 0.10D OR {margin_cv} > 0.25D THEN 'WEAK'
        ELSE 'MODERATE' END)"""


def compounding_class(fcf_cagr: str, eps_cagr: str, share_change: str) -> str:
    return f"""(CASE
        WHEN {fcf_cagr} IS NULL OR {eps_cagr} IS NULL THEN 'INSUFFICIENT_DATA'
        WHEN {fcf_cagr} >= 0.15D AND {eps_cagr} >= 0.15D THEN if({share_change} <= -0.05D, 'EXCELLENT', 'STRONG')
        WHEN {fcf_cagr} >= 0.10D AND {eps_cagr} > 0 THEN 'GOOD'
        WHEN {fcf_cagr} <= 0 OR {eps_cagr} <= 0 THEN 'POOR'
        ELSE 'MODERATE' END)"""


def moat_points(roic: str, roe: str, gross_margin: str, operating_margin: str, margin_cv: str) -> str:
    """Half returns, a quarter margin level (zero counts as missing), a quarter stability."""
    level = f"coalesce(nullif({gross_margin}, 0D), nullif({operating_margin}, 0D), 0D)"
    returns = s.clamp(f"coalesce({roic}, {roe}, 0D) / 0.30D * 100")
    margin = s.clamp(f"{level} / 0.70D * 100")
    stability = s.clamp(f"100 - {margin_cv} * 400")
    return f"({returns} * 0.50D + {margin} * 0.25D + if({margin_cv} IS NULL, 50D, {stability}) * 0.25D)"


def growth_points(rate: str) -> str:
    return s.clamp(f"coalesce({rate}, 0D) / 0.20D * 100")


def compounding_points(eps_cagr: str, fcf_cagr: str, revenue_cagr: str, share_change: str) -> str:
    buyback = s.clamp(f"50 - {share_change} * 1000")
    return (
        f"({growth_points(eps_cagr)} * 0.35D + {growth_points(fcf_cagr)} * 0.35D "
        f"+ {growth_points(revenue_cagr)} * 0.20D + if({share_change} IS NULL, 50D, {buyback}) * 0.10D)"
    )


def valuation_points(cash_yield: str, forward_pe: str, peg_ratio: str) -> str:
    """Yield, multiple and growth-adjusted multiple; a missing (or zero) multiple is neutral."""
    by_yield = f"if({cash_yield} IS NULL, 50D, {s.clamp(f'{cash_yield} / 0.06D * 100')})"
    by_pe = f"if(nullif({forward_pe}, 0D) IS NULL, 50D, {s.clamp(f'100 - ({forward_pe} - 15) * 2')})"
    by_peg = f"if(nullif({peg_ratio}, 0D) IS NULL, 50D, {s.clamp(f'100 - ({peg_ratio} - 1) * 50')})"
    return f"({by_yield} * 0.40D + {by_pe} * 0.35D + {by_peg} * 0.25D)"


def composite(moat: str, compounding: str, valuation: str) -> str:
    w = COMPOSITE_WEIGHTS
    return (
        f"({moat} * {w['moat']}D + {compounding} * {w['compounding']}D + {valuation} * {w['valuation']}D)"
    )


def with_fx_rate(fundamentals: DataFrame, fx: DataFrame) -> DataFrame:
    """Attach the reporting-to-trading rate: 1.0 when no conversion applies, else the lookup."""
    pairs = fx.selectExpr("base AS financial_currency", "quote AS trading_currency", "rate AS _rate")
    foreign = (
        "coalesce(financial_currency <> trading_currency AND financial_currency <> '' "
        "AND trading_currency <> '', false)"
    )
    return fundamentals.join(pairs, ["financial_currency", "trading_currency"], "left").selectExpr(
        *fundamentals.columns,
        f"if({foreign}, _rate, 1D) AS fx_rate",
        f"{foreign} AND _rate IS NULL AS fx_missing",
    )


def score_fundamentals(fundamentals: DataFrame) -> DataFrame:
    """Score every ticker row; needs ``fx_rate`` and ``is_financial`` next to the series."""
    series = fundamentals.selectExpr(
        "*",
        f"{s.roic_history('ebit_series', 'invested_capital_series', 'tax_rate_series')} AS roics",
        f"{s.margin_history('revenue_series', 'operating_income_series')} AS margins",
    )
    measures = series.selectExpr(
        "*",
        f"{s.series_mean('roics')} AS roic",
        "return_on_equity AS roe",
        f"{s.variation('margins')} AS margin_cv",
        f"{s.fraction_at_least('roics', 0.15)} AS pricing_power",
        f"{s.series_cagr('revenue_series')} AS revenue_cagr",
        f"{s.series_cagr('eps_series')} AS eps_cagr",
        f"{s.series_cagr('fcf_series')} AS fcf_cagr",
        f"{s.end_to_end_change('diluted_shares_series')} AS shares_change",
        f"{fcf_yield('free_cash_flow', 'market_cap', 'fx_rate')} AS fcf_yield",
        f"{peg('forward_pe', 'eps_cagr')} AS peg",
    ).drop("roics", "margins")
    return measures.selectExpr(
        "*",
        f"{moat_class('is_financial', 'roic', 'roe', 'margin_cv', 'pricing_power')} AS moat_class",
        f"{compounding_class('fcf_cagr', 'eps_cagr', 'shares_change')} AS compounding_class",
        f"{moat_points('roic', 'roe', 'gross_margin', 'operating_margin', 'margin_cv')} AS moat_points",
        f"{compounding_points('eps_cagr', 'fcf_cagr', 'revenue_cagr', 'shares_change')} AS compounding_points",
        f"{valuation_points('fcf_yield', 'forward_pe', 'peg')} AS valuation_points",
        f"{composite('moat_points', 'compounding_points', 'valuation_points')} AS composite_score",
    )
