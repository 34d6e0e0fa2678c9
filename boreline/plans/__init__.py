"""The registered queries and, beside them, their SQL for an independent engine."""

from __future__ import annotations

from functools import wraps
from importlib import import_module

from boreline.session import attach

MODULES = ("core", "catalog", "interpolation", "proximity", "uncertainty", "grid", "sequence", "ingest")


def _collect(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"boreline.plans.{name}"), attribute)
        overlap = merged.keys() & part.keys()
        if overlap:
            raise ValueError(f"registered twice: {sorted(overlap)}")
        merged.update(part)
    return merged


def _attached(query):
    @wraps(query)
    def run(spark, sf_dir):
        return query(attach(spark), sf_dir)

    return run


def queries() -> dict:
    return {name: _attached(query) for name, query in _collect("QUERIES").items()}


def oracle_sql() -> dict:
    return _collect("ORACLES")
