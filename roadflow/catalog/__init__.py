"""Named queries over the driver tables, each with an optional SQL twin."""

from __future__ import annotations

import importlib.util

from roadflow.catalog.registry import QUERIES, SQL

_MODULES = [
    "scalars", "observations", "frames", "reports", "demand", "network",
    "routing", "vehicles", "movement", "streams", "intervals", "maps", "profiles", "stores",
]


def load() -> None:
    for name in _MODULES:
        if importlib.util.find_spec(f"roadflow.catalog.{name}") is None:
            continue
        importlib.import_module(f"roadflow.catalog.{name}")


__all__ = ["QUERIES", "SQL", "load"]
