"""Expression library.

Functions here take and return SQL expression text, so one operator is a single parsed
expression; wrap the result in ``F.expr`` or pass it to ``selectExpr``. Arguments are
column names or expressions.
"""


def let(name: str, value: str, body: str) -> str:
    """Bind a row-local value once and use it by name inside ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"
