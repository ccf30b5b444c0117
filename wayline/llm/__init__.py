"""Operators for preparing training text, and their queries."""

from wayline.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
