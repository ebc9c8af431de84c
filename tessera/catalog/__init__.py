"""Queries over the test tables, grouped by the kind of operator they exercise."""

import importlib

from tessera.catalog import base

_MODULES = (
    "basket_queries",
    "relational_queries",
    "aggregate_queries",
    "window_queries",
    "scalar_queries",
    "source_queries",
    "text_queries",
    "pair_queries",
    "encoder_queries",
    "model_queries",
)


def load():
    """Import every query module and return the registry."""
    for name in _MODULES:
        importlib.import_module(f"tessera.catalog.{name}")
    return base
