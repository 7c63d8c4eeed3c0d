"""What Python workers need."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator
from typing import TypeVar

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


# Whole texts travel in batches; Spark's own limit would let many long ones gather, in the
# worker and, outside its heap, in the executor.
BATCH_BYTES, SPARK_DEFAULT = "2097152b", "67108864b"


# Workers live on between tasks, more of them than there are cores: freed arrays go back to
# the system.
MEMORY = {
    "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "2097152",
    "ARROW_DEFAULT_MEMORY_POOL": "system",
}


def package_path(spark: SparkSession) -> None:
    """Let workers import this package from where the driver has it, and take small batches."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == SPARK_DEFAULT:
        spark.conf.set(name, BATCH_BYTES)
    env = spark.sparkContext.environment
    for key, value in MEMORY.items():
        env.setdefault(key, value)
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])


T = TypeVar("T")
_HELD: dict[tuple[str, str], object] = {}


def _hand_back() -> None:
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # only some systems can hand memory back
        pass


def begin(owner: str) -> None:
    """Called where a task of an operator begins: what other operators left in this worker goes.

    Workers outlive their tasks, so without this a chain of operators holds the tables of
    all of them at once.
    """
    others = [key for key in _HELD if key[0] != owner]
    for key in others:
        del _HELD[key]
    if others:
        _hand_back()


def task(owner: str) -> Callable[[Callable], Callable]:
    """A function over batches as a task of ``owner`` that leaves nothing but what is held."""

    def wrap(run: Callable) -> Callable:
        def whole(batches: Iterator) -> Iterator:
            begin(owner)
            yield from run(batches)
            _hand_back()

        return whole

    return wrap


def held(owner: str, name: str, make: Callable[[], T]) -> T:
    """An object of this worker, made once and kept until another operator's task begins."""
    key = (owner, name)
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]
