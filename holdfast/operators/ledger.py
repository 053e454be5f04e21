"""Trade ledger: average-cost positions from ordered buys and sells.

Acceptance of a trade depends on every earlier one of its key, so the fold is sequential by
nature. Rows are shuffled by key and sorted inside partitions; the fold then streams through
Arrow batches and carries one small state, so no group is ever held in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

LEDGER_SCHEMA = (
    "portfolio_id bigint, ticker string, shares double, average_cost double, accepted bigint, rejected bigint"
)


def apply_trade(held: float, cost: float, side: str, shares: float, price: float, fees: float, fees_in_cost: bool):
    """(shares, average cost) after one trade, or None when it must be rejected."""
    if shares <= 0 or price <= 0:
        return None
    if side == "BUY":
        paid = shares * price + (fees if fees_in_cost else 0.0)
        return held + shares, (held * cost + paid) / (held + shares)
    if shares > held or (fees_in_cost and fees > shares * price):
        return None
    left = held - shares
    return (left, cost) if left else (0.0, 0.0)


def positions_from_trades(trades: DataFrame, fees_in_cost: bool = False) -> DataFrame:
    """Open and closed positions per (portfolio, ticker); oversold sells are rejected."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, counts = None, (0.0, 0.0), [0, 0]
        for pdf in batches:
            done = []
            for t in pdf.itertuples(index=False):
                if (t.portfolio_id, t.ticker) != key:
                    if key is not None:
                        done.append((*key, *state, *counts))
                    key, state, counts = (t.portfolio_id, t.ticker), (0.0, 0.0), [0, 0]
                after = apply_trade(*state, t.transaction_type, t.shares, t.price_per_share, t.fees, fees_in_cost)
                counts[0 if after else 1] += 1
                state = after or state
            yield _frame(done)
        if key is not None:
            yield _frame([(*key, *state, *counts)])

    ordered = trades.select(
        "portfolio_id", "ticker", "executed_at", "trade_ref", "transaction_type", "shares", "price_per_share", "fees"
    ).repartition("portfolio_id", "ticker").sortWithinPartitions(
        "portfolio_id", "ticker", "executed_at", "trade_ref"
    )
    return ordered.mapInPandas(fold, LEDGER_SCHEMA)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["portfolio_id", "ticker", "shares", "average_cost", "accepted", "rejected"]
    return pd.DataFrame(rows, columns=names)


def cash_checked_trades(trades: DataFrame, opening: DataFrame, fees_in_cost: bool = False) -> DataFrame:
    """Every trade with its verdict when buys also need cash, in order per portfolio.

    The state of a portfolio is its cash and its open positions.
    """
    schema = "portfolio_id bigint, trade_ref string, accepted boolean, cash_after double"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, cash, book = None, 0.0, {}
        for pdf in batches:
            out = []
            for t in pdf.itertuples(index=False):
                if t.portfolio_id != owner:
                    owner, cash, book = t.portfolio_id, t.cash, {}
                gross = t.shares * t.price_per_share
                short = t.transaction_type == "BUY" and cash < gross + t.fees
                after = None if short else apply_trade(
                    *book.get(t.ticker, (0.0, 0.0)), t.transaction_type, t.shares, t.price_per_share, t.fees,
                    fees_in_cost,
                )
                if after:
                    cash += -(gross + t.fees) if t.transaction_type == "BUY" else gross - t.fees
                    if after[0]:
                        book[t.ticker] = after
                    else:
                        book.pop(t.ticker, None)
                out.append((t.portfolio_id, t.trade_ref, bool(after), cash))
            yield pd.DataFrame(out, columns=["portfolio_id", "trade_ref", "accepted", "cash_after"])

    rows = trades.join(opening.select("portfolio_id", "cash"), "portfolio_id").select(
        "portfolio_id", "cash", "executed_at", "trade_ref", "ticker", "transaction_type", "shares",
        "price_per_share", "fees",
    )
    ordered = rows.repartition("portfolio_id").sortWithinPartitions("portfolio_id", "executed_at", "trade_ref")
    return ordered.mapInPandas(fold, schema)
