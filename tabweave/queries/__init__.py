"""Registered queries: one per operator of the inventory."""

import importlib

MODULES = ("scalars", "matching", "joining", "reporting", "grids", "alignments", "streams")


def load():
    """Import every query module and return the registry."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return importlib.import_module(f"{__name__}.registry")
