"""Names for temporary columns that no carried column has."""

from __future__ import annotations

from collections.abc import Iterable


def free_names(columns: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores behind it as keep it apart from ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
