"""Memory of Python workers: an executor keeps idle ones, and what their allocators hold counts against it."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps
from typing import TypeVar

import pyarrow as pa

T = TypeVar("T")


def give_back() -> None:
    """Free memory goes back to the system, as far as the allocators can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def frugal(run: Callable[[Iterator[T]], Iterator[T]]) -> Callable[[Iterator[T]], Iterator[T]]:
    """A function over a partition's batches that gives memory back when it is done."""

    @wraps(run)
    def over(batches: Iterator[T]) -> Iterator[T]:
        yield from run(batches)
        give_back()

    return over
