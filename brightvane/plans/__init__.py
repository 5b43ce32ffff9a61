"""Registered query plans by area."""

from __future__ import annotations


def load() -> None:
    """Imports every module that registers queries."""
    from . import briefing, connectors, content, functions, ranking, relational, streams, textual, writing  # noqa: F401
