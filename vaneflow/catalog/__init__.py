from __future__ import annotations

from importlib import import_module

from .registry import BUILDERS

MODULES = ("sources", "scalars", "joins", "aggregates", "windows", "audits", "strategies", "streams")


def load() -> dict:
    """Import every query module once and return the registered builders."""
    for module in MODULES:
        import_module(f"{__name__}.{module}")
    return BUILDERS
