"""Memory of Python workers."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa

B = TypeVar("B")    # a batch: Arrow or pandas


def give_back() -> None:
    """Memory that this process has freed, but still holds, goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim is not None:
        trim(0)


def giving_back(run: Callable[[Iterator[B]], Iterator[B]]):
    """A function on Arrow or pandas batches. Its worker outlives the task and idles beside the steps that
    follow, so what the task used goes back at its end."""
    def whole(batches: Iterator[B]) -> Iterator[B]:
        try:
            yield from run(batches)
        finally:
            give_back()
    return whole
