"""Names of tables and columns."""

from __future__ import annotations

import re

from emberlog.functions.keccak import keccak256

MAX_NAME = 63


def words(name: str) -> list[str]:
    return re.findall(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z0-9]+|[A-Z]+|[0-9]+", name)


def snake(name: str) -> str:
    return "_".join(w.lower() for w in words(name))


def camel(name: str) -> str:
    first, *rest = words(name) or [""]
    return first.lower() + "".join(w.capitalize() for w in rest)


def pascal(name: str) -> str:
    return "".join(w.capitalize() for w in words(name))


def short(name: str) -> str:
    """Names that a database would cut keep 52 characters and ten digits of their hash."""
    return name if len(name) <= MAX_NAME else f"{name[:52]}_{keccak256(name.encode()).hex()[:10]}"
