"""What a Python worker keeps between tasks: one thing at a time.

Workers live on and serve one operator after another. Vocabularies, networks and automata of the last operator
are let go when the next one asks for its own, so that a worker's memory is that of its largest operator, not the
sum of all.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")
_kept: list[tuple[object, object]] = []


def kept(key: object, make: Callable[[], T]) -> T:
    """The thing under ``key``, made unless it is what was asked for last."""
    if not _kept or _kept[0][0] != key:
        if _kept:
            _kept.clear()
            gc.collect()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)  # else freed memory stays with the process
            except OSError:
                pass
        _kept.append((key, make()))
    return _kept[0][1]
