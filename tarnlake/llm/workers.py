"""Memory of the Python workers. Spark hands a worker from task to task, so an executor goes on holding what one operator
left in them while the next one runs: tables kept for later tasks, and freed memory that the allocators keep back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

_kept: list[dict] = []


def kept() -> dict:
    """A dict that outlives tasks, until a task comes that has no use for it."""
    _kept.append({})
    return _kept[-1]


def give_back() -> None:
    """Freed memory goes to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def drop_kept() -> None:
    if any(_kept):
        for tables in _kept:
            tables.clear()
        give_back()


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task of a ``mapInArrow`` that needs no kept tables: it drops them first, and at its end gives back what it freed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        try:
            yield from task(batches)
        finally:
            give_back()

    return run
