"""Registered queries: each plan module maps names to Spark queries and to SQL twins."""

from __future__ import annotations

import importlib

_MODULES = ["sources", "postings", "history", "terms", "matching", "quality", "records", "places", "people", "streams"]


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in _MODULES:
        module = importlib.import_module(f"postlens.plans.{name}")
        out.update(getattr(module, attribute))
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict:
    return _merged("ORACLES")


def flagship(spark, folder):
    from postlens.plans.matching import best_matches

    return best_matches(spark, folder)
