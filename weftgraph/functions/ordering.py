"""Clauses of ``order_by``: ``f``, ``+f`` or ``-f``. Nulls count as smallest."""

from __future__ import annotations

import re

from ..errors import InvalidExpression

_CLAUSE = re.compile(r"([+-]?)([a-zA-Z][a-zA-Z0-9_]*)\Z")


def parse(clause: str) -> tuple[str, bool]:
    """Field, and whether ascending."""
    m = _CLAUSE.match(clause) if isinstance(clause, str) else None
    if not m:
        raise InvalidExpression(f"order clause {clause!r}")
    return m[2], m[1] != "-"
