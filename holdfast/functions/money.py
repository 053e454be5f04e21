"""Currency-aware money expressions."""

from __future__ import annotations

from holdfast.functions import let

# Display symbol per supported currency.
SYMBOLS = {"USD": "$", "BRL": "R$", "EUR": "€"}


def one_currency(currency: str) -> str:
    """Aggregate: true when a group holds a single currency (min equals max)."""
    return f"(min({currency}) = max({currency}))"


def guarded_sum(amount: str, currency: str) -> str:
    """Aggregate: the sum, or null when the group mixes currencies."""
    return f"(CASE WHEN {one_currency(currency)} THEN sum({amount}) END)"


def strict_sum(amount: str, currency: str) -> str:
    """Aggregate: the sum, failing the job when the group mixes currencies."""
    clash = f"raise_error(concat('cannot mix ', min({currency}), ' with ', max({currency})))"
    return f"(CASE WHEN {one_currency(currency)} THEN sum({amount}) ELSE {clash} END)"


def convert(amount: str, rate: str) -> str:
    """Amount at a rate, rounded half-up to eight places."""
    return f"round(cast({amount} AS decimal(28,8)) * cast({rate} AS decimal(18,8)), 8)"


def half_away(amount: str, places: int) -> str:
    """A double rounded as SQL engines do: scaled, rounded half away from zero, and scaled back in doubles."""
    unit = f"{10**places}D"
    return f"(round({amount} * {unit}) / {unit})"


def fixed(amount: str, places: int = 2, grouped: bool = False) -> str:
    """Text of a double with ``places`` decimals, as printf writes it: its exact binary value, rounded half to even.

    ``format_string`` rounds the shortest decimal instead (0.285 is less than 0.285 in binary). The fraction is cut into
    two parts whose products with 10**places are exact. From 1e18 on a double is whole and ``format_string`` does.
    """
    unit = f"{10**places}D"
    rest = f"((f - h) * {unit})"  # h holds the leading half of the digits of f
    nearest = (
        f"bigint(m) + CASE WHEN (h * {unit} - m - 0.5D) + {rest} > 0 THEN 1 WHEN (h * {unit} - m + 0.5D) + {rest} < 0 THEN -1 "
        f"WHEN m % 2 = 1 AND (h * {unit} - m - 0.5D) + {rest} = 0 THEN 1 "
        f"WHEN m % 2 = 1 AND (h * {unit} - m + 0.5D) + {rest} = 0 THEN -1 ELSE 0 END"
    )
    whole = f"i + n div {10**places}"
    shown = f"format_number({whole}, 0)" if grouped else f"string({whole})"
    text = let("n", nearest, f"concat({shown}, '.', lpad(string(n % {10**places}), {places}, '0'))")
    text = let("h", "134217729D * f - (134217729D * f - f)", let("m", f"rint(f * {unit})", text))
    text = let("i", "floor(abs(d))", let("f", "abs(d) - i", text))
    large = f"format_string('%{',' if grouped else ''}.{places}f', d)"
    return let(
        "d", f"double({amount})",
        f"CASE WHEN abs(d) < 1e18D THEN concat(if(left(string(d), 1) = '-', '-', ''), {text}) "
        f"WHEN d IS NULL THEN NULL WHEN isnan(d) THEN 'nan' WHEN abs(d) = double('infinity') THEN if(d > 0, 'inf', '-inf') ELSE {large} END",
    )


def display(amount: str, currency: str) -> str:
    """Symbol and amount with two decimals; a double is shown by its exact value, so -0.0 keeps its sign."""
    symbols = ", ".join(f"'{k}', '{v}'" for k, v in SYMBOLS.items())
    return f"concat(try_element_at(map({symbols}), {currency}), ' ', {fixed(amount, grouped=True)})"
