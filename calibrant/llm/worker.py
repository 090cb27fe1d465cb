"""What a Python worker keeps between batches and tasks: one operator's objects at a time.

Workers live on from stage to stage. An operator's tables and caches are kept while tasks of
that operator follow each other, and freed when another operator's task begins, so that a
pipeline's workers never hold what several stages have taken.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import Any

_HELD: dict[tuple, Any] = {}
_AT = [""]


def free() -> None:
    """Forget everything kept, and give the memory back to the system."""
    import pyarrow as pa

    _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def enter(operator: str) -> None:
    """A task of this operator begins: what other operators kept is freed."""
    if _AT[0] not in ("", operator):
        free()
    _AT[0] = operator


def tenant(operator: str, key: str, make: Callable[[], Any]) -> Any:
    """The object that an operator keeps under key; made when it is not there."""
    enter(operator)
    if (operator, key) not in _HELD:
        _HELD.clear()  # another model of the same operator
        _HELD[operator, key] = make()
    return _HELD[operator, key]
