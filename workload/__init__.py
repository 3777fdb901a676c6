"""Checked queries of the engine over the supplied tables."""

from importlib import import_module

MODULES = ["ranking", "records", "stores", "texts", "flows"]


def all_queries() -> None:
    """Import every module, which registers its queries."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
