"""Registered queries, one module per area."""

from cadenza.plans import events, royalty, sqlkeys, upkeep  # noqa: F401
from cadenza.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
