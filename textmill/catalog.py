"""All queries outside the llm subpackage, with their SQL."""

from __future__ import annotations

import importlib

from textmill.queries import base

MODULES = ("corpus", "training", "evaluation", "various", "streams")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"textmill.queries.{name}")


def queries() -> dict:
    _load()
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(base.SQL)
