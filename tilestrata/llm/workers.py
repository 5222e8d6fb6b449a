"""What a Python worker keeps between its tasks.

Spark runs the tasks of many stages, and of many queries, in the same Python workers. Each keeps the tables of one operator
at a time, and what a task has freed goes back to the system, so that a worker's memory is that of its present task.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa

_held: dict[Hashable, object] = {}


def trim() -> None:
    """Gives freed memory back to the system (where the C library can)."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def drop() -> None:
    _held.clear()


def keep(key: Hashable, build: Callable[[], object]):
    """What build() makes, kept for the worker's next tasks; what was kept by another key goes first."""
    if key not in _held:
        drop()
        trim()
        _held[key] = build()
        trim()
    return _held[key]


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False):
    """run for mapInArrow, without what operators of other stages kept (unless it keeps tables itself); trimmed at the end of each task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            drop()
        try:
            yield from run(batches)
        finally:
            trim()

    return task
