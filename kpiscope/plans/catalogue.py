"""All registered queries."""

from __future__ import annotations

import importlib
import pkgutil

import kpiscope.plans as plans
from kpiscope.plans.registry import ORACLES, QUERIES, Query


def _load() -> None:
    for mod in pkgutil.iter_modules(plans.__path__):
        if mod.name.startswith("on_"):
            importlib.import_module(f"kpiscope.plans.{mod.name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
