"""Registered queries."""

from fillwatch.plans import queries_analysis, queries_core, queries_io, queries_model  # noqa: F401
from fillwatch.plans.registry import ORACLES, QUERIES  # noqa: F401
