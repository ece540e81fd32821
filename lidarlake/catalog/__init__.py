"""Named queries over the test tables and the SQL that checks them."""

from importlib import import_module

from lidarlake.catalog.registry import ORACLES, QUERIES

_MODULES = ("points", "poses", "places", "matching", "flows", "localizing")


def _load():
    for m in _MODULES:
        import_module(f"lidarlake.catalog.{m}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLES)
