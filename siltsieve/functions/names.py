"""Names for helper columns beside a caller's own."""

from __future__ import annotations

from collections.abc import Sequence


def fresh(columns: Sequence[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as it takes to be none of columns (upper and lower case are alike)."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out
