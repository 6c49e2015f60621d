"""Registered queries over the domain views, each with the SQL that must give the same rows."""

from importlib import import_module

from . import registry

MODULES = ("basic", "more", "planning", "locks", "targets", "stateful")


def _load():
    for name in MODULES:
        import_module(f"{__name__}.{name}")


def queries():
    _load()
    return registry.QUERIES


def oracle_sql():
    _load()
    return registry.ORACLE
