"""Collects the queries of the media modules and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["audio", "images", "containers", "video", "coding", "syntax", "media", "references", "stored", "live", "recovery", "slices", "prediction"]


def _gather(attribute: str) -> dict:
    found = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"reelspark.plans.{name}"), attribute)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE_SQL")
