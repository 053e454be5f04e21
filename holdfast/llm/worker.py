"""What a Python worker keeps from task to task: the caches of one operator at a time."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import Any

_KEPT: dict[tuple[str, Any], Any] = {}


def trim() -> None:
    """Give freed memory back to the machine, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def enter(owner: str) -> None:
    """Drop what other operators have left in this worker."""
    others = [k for k in _KEPT if k[0] != owner]
    for key in others:
        del _KEPT[key]
    if others:
        gc.collect()
        trim()


def kept(owner: str, key: Any, make: Callable[[], Any]) -> Any:
    """The cache of an operator, made where this worker has none."""
    enter(owner)
    if (owner, key) not in _KEPT:
        _KEPT[owner, key] = make()
    return _KEPT[owner, key]
