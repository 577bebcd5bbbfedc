"""Whole plans: registered queries over the tables."""

from . import lookups, national, registers, registry, rules  # noqa: F401
