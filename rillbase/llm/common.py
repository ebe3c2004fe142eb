"""What the operators of this subpackage share: places, tables and batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillbase.storage import shared_place, shared_root, written

__all__ = ["by_chars", "fresh_worker", "kept_in_worker", "shared_place", "shared_root", "texts_of", "written"]


#: What a worker keeps from task to task, to be dropped when another operator's tasks come.
_KEPT: list = []


def kept_in_worker(cache):
    """``cache``, a dict or list at the level of a module, which ``fresh_worker`` empties."""
    _KEPT.append(cache)
    return cache


def fresh_worker(large_arrays: bool = False) -> None:
    """Called where a task begins that has no use for what earlier ones kept: drop that, and give free memory back to the system. With ``large_arrays``
    the worker gives large arrays back as soon as they are freed from now on."""
    for cache in _KEPT:
        cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL("libc.so.6")
        if large_arrays:
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and the columns in ``more``; anything else is left out."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def by_chars(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose ``column`` holds about ``most`` bytes each, or one row."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    begin = held = 0
    for i, n in enumerate(sizes):
        if held and held + (n or 0) > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n or 0
    if begin < len(sizes):
        yield batch.slice(begin)
