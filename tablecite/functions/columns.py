"""Column-name arguments."""

from __future__ import annotations

from collections.abc import Sequence


def names(cols: str | Sequence[str]) -> list[str]:
    """One name or several, as a list."""
    return [cols] if isinstance(cols, str) else list(cols)
