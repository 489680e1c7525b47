"""Memory that Python workers hand back: they outlive tasks, and later stages share an executor's memory with them."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa

_CLEAR: dict[str, Callable[[], None]] = {}
_OWNER: list[str] = [""]


def remembers(name: str, clear: Callable[[], None]) -> None:
    """Name an operator's memory and what empties it."""
    _CLEAR[name] = clear


def claim(name: str) -> None:
    """Empty what other operators have left in this worker, so that it holds the memory of one at a time."""
    if _OWNER[0] != name:
        for other, clear in _CLEAR.items():
            if other != name:
                clear()
        _OWNER[0] = name
        give_back()


def give_back() -> None:
    """Return freed memory of this process to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
