"""Give memory back to the system between pieces of work.

Python workers are reused: what one task's large arrays leave in the
allocators would stay with the executor through all later stages.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(batches: Iterator) -> Iterator:
    """``batches``, with memory given back when they end."""
    try:
        yield from batches
    finally:
        give_back()
