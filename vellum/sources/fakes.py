"""Stand-ins for outside services, for tests and queries."""

from __future__ import annotations


def bracketed(units: list[str]) -> list[str | None]:
    """A translator that puts every unit in brackets."""
    return [f"[{u}]" for u in units]
