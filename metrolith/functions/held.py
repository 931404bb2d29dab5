"""Column expressions that are built once and used by every plan.

Each call of a function on a column goes to the JVM and back, which for extraction's thousands of them takes
far longer than the optimizer.  Its expressions are over the plan's own names, so they are the same each time.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark import SparkContext
from pyspark.errors import utils as _debugging

T = TypeVar("T")
_held: dict = {}


def held(name: object, build: Callable[[], T]) -> T:
    """What build() makes, kept under the name for as long as this JVM runs."""
    gateway = SparkContext._gateway
    if _held.get("gateway") is not gateway:
        _held.clear()
        _held["gateway"] = gateway
    if name not in _held:
        # Call sites within this package would tell nobody anything, and finding them takes most of the time.
        before = getattr(_debugging, "_enable_debugging_cache", None)
        _debugging._enable_debugging_cache = False
        try:
            _held[name] = build()
        finally:
            _debugging._enable_debugging_cache = before
    return _held[name]
