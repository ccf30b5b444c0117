"""Registered queries: each binds one operator to the given tables.

Every entry pairs a Spark query with the SQL that must give the same rows.
"""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

MODULES = ("trips", "trajectory", "captions", "places", "archive", "formats", "live")

for _name in MODULES:
    try:
        importlib.import_module(f"{__name__}.{_name}")
    except ModuleNotFoundError as err:
        if err.name != f"{__name__}.{_name}":
            raise

__all__ = ["ORACLES", "QUERIES"]
