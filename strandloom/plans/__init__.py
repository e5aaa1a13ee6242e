"""Query plans of the library, grouped by kind of operator."""

from __future__ import annotations

import importlib
import pkgutil


def load_queries() -> None:
    """Import every plan module so that its queries are registered."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
