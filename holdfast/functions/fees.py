"""Broker fee arithmetic and cash sizing."""

from __future__ import annotations

from dataclasses import dataclass

from holdfast.functions import let


@dataclass(frozen=True)
class FeeSchedule:
    """A fixed fee per started tranche and the tolerated fee share of an order."""

    tranche: float = 1000.0
    cost: float = 2.50
    max_impact_pct: float = 1.0
    max_legs: int = 6

    @property
    def floor(self) -> float:
        """Smallest economic order: where one fee equals the tolerated share."""
        return self.cost / (self.max_impact_pct / 100)


DEFAULT_FEES = FeeSchedule()
NO_AMOUNTS = "cast(array() AS array<double>)"


def order_fee(amount: str, fees: FeeSchedule = DEFAULT_FEES) -> str:
    return f"(CASE WHEN {amount} <= 0 THEN 0D ELSE ceil({amount} / {fees.tranche}D) * {fees.cost}D END)"


def tranche_boundary(cash: str, fees: FeeSchedule = DEFAULT_FEES) -> str:
    """The largest first leg that stays within one tranche."""
    return f"least({fees.tranche}D, {cash})"


def guardrails(cash: str, fees: FeeSchedule = DEFAULT_FEES) -> dict[str, str]:
    """Where orders become economic: the floor is the fixed point at which one fee is the tolerated share."""
    floor = f"{fees.cost / (fees.max_impact_pct / 100)}D"
    return {
        "min_order": floor,
        "first_order": f"{cash} >= {floor}",
        "second_order": f"{cash} >= 2 * {floor}",
        "boundary": tranche_boundary(cash, fees),
        # A split at a tranche boundary costs no more than one order of the same cash.
        "split_premium": (
            f"{order_fee(tranche_boundary(cash, fees), fees)} + "
            f"{order_fee(f'({cash} - {tranche_boundary(cash, fees)})', fees)} - {order_fee(cash, fees)}"
        ),
    }


def total_order_fee(amounts: str, fees: FeeSchedule = DEFAULT_FEES) -> str:
    return f"aggregate({amounts}, 0D, (acc, paid) -> acc + {order_fee('paid', fees)})"


def max_orders(cash: str, fees: FeeSchedule = DEFAULT_FEES) -> str:
    """Order count a cash level supports: two when small, then one per tranche up to six."""
    return (
        f"(CASE WHEN {cash} < {fees.tranche * 3}D THEN 2 "
        f"ELSE least({fees.max_legs}, int(floor({cash} / {fees.tranche}D))) END)"
    )


def score_split(first: str, second: str, cash: str) -> str:
    """First leg of a two-way split by score; null when the scores cancel out."""
    return f"({cash} * try_divide({first}, {first} + {second}))"


def two_way_fee(cash: str, share: str, fees: FeeSchedule = DEFAULT_FEES) -> str:
    """Fee of a plain proportional two-way split, ignoring tranche alignment."""
    first, second = f"({cash} * {share})", f"({cash} - {cash} * {share})"
    single = order_fee(cash, fees)
    return (
        f"(CASE WHEN {cash} < {fees.floor}D THEN 0D WHEN {cash} < {fees.floor * 2}D THEN {single} "
        f"WHEN {first} < {fees.floor}D OR {second} < {fees.floor}D THEN {single} "
        f"ELSE {order_fee(first, fees)} + {order_fee(second, fees)} END)"
    )


def tranche_amounts(scores: str, cash: str, fees: FeeSchedule = DEFAULT_FEES) -> str:
    """Whole-tranche legs for large cash, shared out by score (at most six legs).

    Each leg starts from the floor of its share, at least one tranche. Missing tranches all
    go to the leg with the largest fraction; surplus ones drain from the legs in order of
    smallest fraction, never below one. Cash short of the last tranche comes off the
    largest leg that stays above the floor; an empty array means no such plan exists.
    """
    tranches = f"ceil({cash} / {fees.tranche}D)"
    legs = f"slice({scores}, 1, int(least(size({scores}), {tranches}, {fees.max_legs})))"
    share = (
        "transform(s, v -> CASE WHEN total > 0 "
        f"THEN v / total * double({tranches}) ELSE double({tranches}) / size(s) END)"
    )
    state = (
        "transform(share, (t, i) -> struct(t - floor(t) AS frac, i AS pos, "
        "greatest(1D, double(floor(t))) AS units))"
    )
    gap = f"double({tranches}) - aggregate(legs, 0D, (acc, g) -> acc + g.units)"
    fullest = "array_sort(transform(legs, g -> struct(-g.frac AS f, g.pos AS pos)))[0].pos"
    before = (
        "aggregate(filter(legs, o -> o.frac < g.frac OR (o.frac = g.frac AND o.pos < g.pos)), "
        "0D, (acc, o) -> acc + o.units - 1)"
    )
    balanced = (
        f"transform(legs, g -> {fees.tranche}D * CASE "
        "WHEN gap > 0 AND g.pos = fullest THEN g.units + gap "
        f"WHEN gap < 0 THEN g.units - least(g.units - 1, greatest(0D, -gap - {before})) "
        "ELSE g.units END)"
    )
    able = f"array_max(filter(amounts, a -> a - extra >= {fees.floor}D))"
    trimmed = (
        "transform(amounts, (a, i) -> CASE WHEN i + 1 = array_position(amounts, able) "
        "THEN a - extra ELSE a END)"
    )
    fitted = (
        f"CASE WHEN extra <= 0 THEN amounts WHEN able IS NULL THEN {NO_AMOUNTS} ELSE {trimmed} END"
    )
    checked = f"CASE WHEN exists(fitted, a -> a < {fees.floor}D) THEN {NO_AMOUNTS} ELSE fitted END"
    total = "aggregate(s, 0D, (acc, v) -> acc + v)"
    extra = f"aggregate(amounts, 0D, (acc, a) -> acc + a) - {cash}"
    body = let("fitted", fitted, checked)
    body = let("extra", extra, let("able", able, body))
    body = let("amounts", balanced, body)
    body = let("gap", gap, let("fullest", fullest, body))
    body = let("share", share, let("legs", state, body))
    body = let("total", total, body)
    picked = let("s", legs, body)
    return f"(CASE WHEN size({scores}) = 0 OR {cash} <= 0 THEN {NO_AMOUNTS} ELSE {picked} END)"


def order_amounts(scores: str, cash: str, fees: FeeSchedule = DEFAULT_FEES) -> str:
    """Order sizes for ranked candidates: none, one, two or one per tranche leg."""
    floor = fees.floor
    single = order_fee(cash, fees)
    large_ok = f"size(large) > 0 AND {total_order_fee('large', fees)} <= {single}"
    pair = f"array(first, {cash} - first)"
    pair_ok = (
        f"first >= {floor}D AND {cash} - first >= {floor}D "
        f"AND {total_order_fee(pair, fees)} <= {single}"
    )
    wants_large = f"size({scores}) >= 3 AND {cash} >= {fees.tranche * 3}D"
    large = f"CASE WHEN {wants_large} THEN {tranche_amounts(scores, cash, fees)} ELSE {NO_AMOUNTS} END"
    first = (
        f"CASE WHEN size({scores}) >= 2 AND {cash} >= {floor * 2}D "
        f"THEN {score_split(f'{scores}[0]', f'{scores}[1]', cash)} END"
    )
    choice = f"CASE WHEN {large_ok} THEN large WHEN {pair_ok} THEN {pair} ELSE array({cash}) END"
    sized = let("large", large, let("first", first, choice))
    return f"(CASE WHEN size({scores}) = 0 OR {cash} < {floor}D THEN {NO_AMOUNTS} ELSE {sized} END)"


def deployable_bound(cash: str, candidates: str, fees: FeeSchedule = DEFAULT_FEES) -> str:
    """Most cash any plan can place when every order is zero or at least the floor."""
    return f"(CASE WHEN {cash} >= {fees.floor}D AND {candidates} >= 1 THEN {cash} ELSE 0D END)"


def economic_floor(cost: str, tolerance: str) -> str:
    """Floor of an arbitrary schedule; null for a negative cost or non-positive tolerance."""
    return f"(CASE WHEN {cost} >= 0 AND {tolerance} > 0 THEN try_divide({cost}, {tolerance}) END)"
