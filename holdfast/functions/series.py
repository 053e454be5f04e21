"""Oldest-first yearly series: growth, variation, history and coercion."""

from __future__ import annotations

DEFAULT_TAX_RATE = 0.21


def clamp(value: str, low: float = 0.0, high: float = 100.0) -> str:
    return f"greatest({low}D, least({high}D, {value}))"


def series_cagr(x: str) -> str:
    """Growth per step between the two ends; null unless both ends are positive."""
    first, last = f"get({x}, 0)", f"get({x}, size({x}) - 1)"
    return (
        f"(CASE WHEN size({x}) >= 2 AND {first} > 0 AND {last} > 0 "
        f"THEN pow({last} / {first}, 1D / (size({x}) - 1)) - 1 END)"
    )


def series_mean(x: str) -> str:
    return f"try_divide(aggregate({x}, 0D, (acc, v) -> acc + v), size({x}))"


def variation(x: str) -> str:
    """Population standard deviation over the absolute mean."""
    return (
        f"element_at(transform(array({series_mean(x)}), m -> CASE WHEN size({x}) >= 2 AND m <> 0 THEN "
        f"sqrt(aggregate({x}, 0D, (acc, v) -> acc + (v - m) * (v - m)) / size({x})) / abs(m) END), 1)"
    )


def roic_history(ebit: str, capital: str, tax: str) -> str:
    """After-tax operating profit over capital, newest first, aligned at the newest end."""
    return (
        f"filter(transform(zip_with(reverse({ebit}), reverse({capital}), (e, k) -> struct(e, k)), "
        f"(p, i) -> CASE WHEN p.k > 0 THEN "
        f"p.e * (1 - coalesce(get(reverse({tax}), i), {DEFAULT_TAX_RATE}D)) / p.k END), r -> r IS NOT NULL)"
    )


def margin_history(revenue: str, income: str) -> str:
    """Operating margin newest first; periods without revenue are skipped."""
    return (
        f"filter(zip_with(reverse({revenue}), reverse({income}), (r, i) -> try_divide(i, r)), "
        "m -> m IS NOT NULL)"
    )


def fraction_at_least(x: str, threshold: float) -> str:
    return f"coalesce(try_divide(size(filter({x}, v -> v >= {threshold}D)), size({x})), 0D)"


def end_to_end_change(x: str) -> str:
    first, last = f"get({x}, 0)", f"get({x}, size({x}) - 1)"
    return f"(CASE WHEN size({x}) >= 2 THEN try_divide({last} - {first}, {first}) END)"


def implied_series(growth: str, latest: str, periods: int = 6) -> str:
    """History implied by a growth rate, oldest first; empty for unusable inputs."""
    rate = f"coalesce({growth}, 0D)"
    return (
        f"(CASE WHEN {latest} > 0 AND {rate} > -0.95D AND {periods} >= 2 THEN "
        f"transform(sequence({periods} - 1, 0, -1), i -> {latest} / pow(1 + {rate}, i)) "
        "ELSE cast(array() AS array<double>) END)"
    )


def steady_share_series(periods: int = 6) -> str:
    return f"transform(sequence(0, {periods} - 1), i -> 100D - i * 0.4D)"


def finite(value: str) -> str:
    """Numeric text or number to DOUBLE; anything non-finite or non-numeric is null."""
    number = f"try_cast({value} AS double)"
    return f"(CASE WHEN NOT isnan({number}) AND abs({number}) < double('infinity') THEN {number} END)"


def first_percent(*values: str) -> str:
    return f"(coalesce({', '.join(finite(v) for v in values)}) / 100)"
