"""Constraint predicates and policy comparison for one recommendation row.

Every rule maps a row of (recommendation joined to its scenario) to an array of
violation codes; the scenario's ticker lists are normalized. Rules live in an ordered registry, so a new governance rule is one
entry; the verdict is the concatenation of all rules.
"""

from __future__ import annotations

from collections.abc import Callable

from holdfast.functions import fees as fee

BLANKS = r"' \t\n\r\f'"
CASH_TOLERANCE = 0.01
NO_CODES = "cast(array() AS array<string>)"

# Violation code -> reported failure class.
CODED_CLASSES = {
    "ticker_not_allowed": "out_of_universe",
    "already_owned": "already_owned_violation",
    "concentration_breach": "concentration_breach",
    "non_positive_order": "non_positive_order",
    "below_min_order": "below_floor_order",
    "unsupported_fact": "ungrounded_fact",
}
PLAIN_CLASSES = {
    "too_many_recommendations": "too_many_recommendations",
    "amounts_required": "malformed_amounts",
    "amount_count_mismatch": "malformed_amounts",
    "non_finite_amount": "malformed_amounts",
    "cash_exceeded": "cash_overrun",
    "cash_underdeployed": "cash_underdeployment",
    "unnecessary_split_fee": "fee_worsening_split",
}


def clean_ticker(ticker: str) -> str:
    return f"upper(btrim({ticker}, {BLANKS}))"


def normalize_tickers(tickers: str) -> str:
    """Upper-case, strip, drop blanks and repeats; the first occurrence keeps its place."""
    return f"array_distinct(filter(transform({tickers}, t -> {clean_ticker('t')}), t -> t <> ''))"


def jaccard(left: str, right: str) -> str:
    shared, union = f"size(array_intersect({left}, {right}))", f"size(array_union({left}, {right}))"
    return f"coalesce(try_divide({shared}, {union}), 1D)"


def flag(condition: str, code: str) -> str:
    return f"if({condition}, array('{code}'), {NO_CODES})"


def coded(code: str, values: str) -> str:
    return f"transform({values}, v -> concat('{code}:', v))"


def too_many() -> str:
    return flag("size(picks) > max_recommendations", "too_many_recommendations")


# What each pick ``t`` is tested for, in the order in which its codes are listed.
MEMBERSHIP = {
    "ticker_not_allowed": "NOT array_contains(allowed_tickers, t)",
    "already_owned": "add_only AND array_contains(owned_tickers, t)",
    "restricted_ticker": "array_contains(restricted_tickers, t)",
    "concentration_breach": "array_contains(concentration_blocked_tickers, t)",
}


def membership() -> str:
    """Codes pick by pick: all of the first pick, then all of the second, and so on."""
    tests = ", ".join(f"if({test}, concat('{code}:', t), NULL)" for code, test in MEMBERSHIP.items())
    return f"flatten(transform(picks, t -> filter(array({tests}), v -> v IS NOT NULL)))"


def normalized_lists(columns: list[str]) -> dict[str, str]:
    """Scenario ticker lists made clean once, before any run is joined; a missing list is empty."""
    lists = [
        c for c in (
            "allowed_tickers", "owned_tickers", "policy_tickers", "restricted_tickers", "concentration_blocked_tickers",
        ) if c in columns
    ]
    return {c: f"coalesce({normalize_tickers(c)}, {NO_CODES})" for c in lists}


def total_amount(amounts: str) -> str:
    return f"aggregate({amounts}, 0D, (acc, x) -> acc + x)"


def _sized_orders(fees: fee.FeeSchedule) -> str:
    used = total_amount("amounts")
    short = (
        "min_cash_deployment_fraction IS NOT NULL AND cash >= min_order_amount "
        f"AND {used} + {CASH_TOLERANCE}D < cash * min_cash_deployment_fraction"
    )
    per_leg = (
        "filter(zip_with(picks, amounts, (t, x) -> CASE WHEN x <= 0 THEN concat('non_positive_order:', t) "
        "WHEN x < min_order_amount THEN concat('below_min_order:', t) END), v -> v IS NOT NULL)"
    )
    split = f"{fee.total_order_fee('amounts', fees)} > {fee.order_fee(used, fees)}"
    return (
        f"concat({flag(f'{used} > cash + {CASH_TOLERANCE}D', 'cash_exceeded')}, "
        f"{flag(short, 'cash_underdeployed')}, {per_leg}, {flag(split, 'unnecessary_split_fee')})"
    )


def amount_rules(fees: fee.FeeSchedule = fee.DEFAULT_FEES) -> str:
    """Sizing checks; a structural failure (missing, misaligned, non-finite) ends them."""
    missing = "amounts_required AND NOT (size(picks) = 0 AND cash < min_order_amount)"
    odd = "exists(amounts, x -> isnan(x) OR abs(x) = double('infinity'))"
    return (
        f"(CASE WHEN size(amounts) = 0 THEN {flag(missing, 'amounts_required')} "
        "WHEN size(amounts) <> size(picks) THEN array('amount_count_mismatch') "
        f"WHEN {odd} THEN array('non_finite_amount') ELSE {_sized_orders(fees)} END)"
    )


def unsupported_facts() -> str:
    """Cited facts outside the scenario; repeats count every time they are cited."""
    unknown = "filter(cited_fact_ids, f -> NOT array_contains(available_fact_ids, f))"
    return coded("unsupported_fact", unknown)


RULES: dict[str, Callable[[], str]] = {
    "too_many": too_many,
    "tickers": membership,
    "amounts": amount_rules,
    "facts": unsupported_facts,
}


def violations(rules: dict[str, Callable[[], str]] | None = None) -> str:
    return f"concat({', '.join(rule() for rule in (rules or RULES).values())})"


def policy_comparison(picks: str, policy: str, k: str) -> dict[str, str]:
    """Overlap with the policy's first k tickers, as named expressions; both lists are normalized."""
    top = f"slice({picks}, 1, {k})"
    wanted = f"slice({policy}, 1, {k})"
    shared = f"size(array_intersect({top}, {wanted}))"
    return {
        "overlap_at_k": shared,
        "agreement_at_k": f"if({k} = 0, if(size({picks}) = 0, 1D, 0D), try_divide({shared}, {k}))",
        "policy_jaccard": jaccard(top, wanted),
        "missing_policy": f"array_except({wanted}, {top})",
        "extra_tickers": f"array_except({top}, {wanted})",
    }


def violation_class(violation: str) -> str:
    """Failure class of one violation code."""
    coded_map = ", ".join(f"'{k}', '{v}'" for k, v in CODED_CLASSES.items())
    plain_map = ", ".join(f"'{k}', '{v}'" for k, v in PLAIN_CLASSES.items())
    head = f"if(contains({violation}, ':'), split_part({violation}, ':', 1), NULL)"
    return (
        f"coalesce(try_element_at(map({coded_map}), {head}), "
        f"try_element_at(map({plain_map}), {violation}), {violation})"
    )


def allocation_usable(tickers: str, amounts: str) -> str:
    return f"(size({amounts}) > 0 AND size({amounts}) = size({tickers}) AND {total_amount(amounts)} > 0)"
