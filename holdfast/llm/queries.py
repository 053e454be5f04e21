"""Imports every query module of this subpackage."""

from holdfast.llm import q_indexes, q_jaccard, q_models, q_native, q_text, q_tokens  # noqa: F401
from holdfast.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
