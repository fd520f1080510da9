"""Registered queries, one module per part of the package."""

from queries import choice, explain, models, operations, prep, profile, sources

MODULES = (sources, profile, prep, models, choice, explain, operations)
