"""Queries over the given tables, each with a DuckDB check where one exists."""

from importlib import import_module
from pkgutil import iter_modules


def load_all() -> None:
    """Import every ``q_*`` module so that its queries register."""
    for module in iter_modules(__path__):
        if module.name.startswith("q_"):
            import_module(f"{__name__}.{module.name}")
