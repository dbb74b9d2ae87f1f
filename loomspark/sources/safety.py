"""What names and paths from outside may be."""

from __future__ import annotations

import posixpath
import re


def identifier(name: str) -> str:
    """The name, if it is made of letters, digits and underscores only."""
    if not re.fullmatch(r"[A-Za-z0-9_]+", name or ""):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def quoted(name: str) -> str:
    """A name for use in SQL."""
    return "`" + name.replace("`", "``") + "`"


def allowed_table(name: str, tables) -> str:
    if identifier(name) not in tables:
        raise ValueError(f"unknown table: {name}")
    return name


def allowed_path(path: str, roots: list[str]) -> str:
    """The path, if it is below one of the roots once `..` and the like are resolved."""
    scheme, _, rest = path.rpartition("://")
    clean = posixpath.normpath(rest)
    for root in roots:
        own_scheme, _, own = root.rpartition("://")
        own = posixpath.normpath(own)
        if scheme == own_scheme and (clean == own or clean.startswith(own.rstrip("/") + "/")):
            return path
    raise ValueError(f"path not allowed: {path}")
