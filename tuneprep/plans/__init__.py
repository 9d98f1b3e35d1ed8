"""Registered queries over the star-schema tables, each with its SQL counterpart."""

from tuneprep.plans import catalogue, chats, files, history, sizing  # noqa: F401
from tuneprep.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
