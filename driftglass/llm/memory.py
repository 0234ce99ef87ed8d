"""Memory of Python workers: a worker outlives its tasks, and what one task has freed should not count for the next."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass
