"""What a Python worker remembers between tasks: of one operator at a time, as workers serve one after the other."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


def trim() -> None:
    """Return freed memory to the system, as workers are kept between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function over batches that returns freed memory when the task ends: what one stage has freed isn't held beside the next one's."""

    def ran(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return ran


_held: dict = {"name": None, "values": {}}


def cache(name: str) -> dict:
    """The named operator's values. Those of any other operator are dropped and their memory is returned."""
    if _held["name"] != name:
        _held["name"] = name
        if _held["values"]:
            _held["values"] = {}
            trim()
    return _held["values"]
