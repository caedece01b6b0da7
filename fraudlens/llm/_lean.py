"""Giving memory back when a task's Python part ends: workers are kept for later tasks, of other functions too."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa


def trim() -> None:
    """Returns freed memory of Arrow and of the C library to the system, where the library can."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, with what it held given back at its end."""

    @functools.wraps(run)
    def leaning(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(rows)
        finally:
            trim()

    return leaning
