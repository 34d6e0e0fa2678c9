"""Operators of a training-data pipeline: text in, scores, links, spans and files out.

Nothing else in the library imports this package.  Every module holds one operator with its general interface, and below
it the registered query and, where SQL can express it, the SQL of an independent engine.
"""

from __future__ import annotations

from functools import wraps
from importlib import import_module

from boreline.session import attach

MODULES = (
    "codebooks", "contamination", "contexts", "forest", "languages", "mixture", "phrases", "quality", "sentences", "setjoin", "suffixes",
    "superminhash", "tokenfiles",
)


def _collect(attribute: str) -> dict:
    return {name: part for module in MODULES for name, part in getattr(import_module(f"{__name__}.{module}"), attribute).items()}


def _attached(query):
    @wraps(query)
    def run(spark, sf_dir):
        return query(attach(spark), sf_dir)

    return run


def queries() -> dict:
    return {name: _attached(query) for name, query in _collect("QUERIES").items()}


def oracle_sql() -> dict:
    return _collect("ORACLES")
