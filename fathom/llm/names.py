"""Column names that a caller's table doesn't have."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(docs: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores before it until docs has no such column, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out
