"""Keeping long-lived Python workers small."""

from __future__ import annotations

import ctypes
import functools

import pyarrow as pa


@functools.cache
def _trim():
    """The C library's call that gives free memory back, or None where it has none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None


def give_back() -> None:
    """Memory that this worker has freed goes back to the system: a worker serves one stage after the other, and what its largest batch took
    would stay beside the executor's heap through all of them."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def lean(fn):
    """`fn` of a batch, with the memory given back that it has freed."""

    @functools.wraps(fn)
    def run(*batch):
        try:
            return fn(*batch)
        finally:
            give_back()

    return run


def lean_batches(fn):
    """`fn` of an iterator of batches, the same."""

    @functools.wraps(fn)
    def run(batches):
        for out in fn(batches):
            yield out
            give_back()
        give_back()

    return run
