"""What a Python worker keeps between tasks: the tables of one operator at a time."""

from __future__ import annotations

import pyarrow as pa

_HELD: dict[str, dict] = {}


def own(name: str) -> dict:
    """The cache of an operator in this worker.

    Those of other operators are dropped: a pipeline's stages run in the same workers one after another, and what one keeps
    would stay in memory while the next ones run.
    """
    others = [k for k in _HELD if k != name]
    for k in others:
        del _HELD[k]
    if others:
        pa.default_memory_pool().release_unused()
    return _HELD.setdefault(name, {})
