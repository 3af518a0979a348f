"""Paths from archives, checked before they are used."""

from __future__ import annotations

import re


def checked(path: str) -> str:
    """``path`` if it stays inside the folder that it is joined to."""
    if not path or path.startswith("/") or "\0" in path or re.match(r"[A-Za-z]:", path) or re.search(r"(^|[/\\])\.\.([/\\]|$)", path):
        raise ValueError(f"unsafe path in archive: {path!r}")
    return path
