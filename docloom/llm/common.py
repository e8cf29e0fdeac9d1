"""Shared plumbing: the folder all executors see, written tables, Arrow helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.plumbing import fresh_path, shared_dir, written  # noqa: F401

#: Separators of words, as bytes: the pattern ``[^\x20\x09-\x0D]+`` on UTF-8.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


#: What this worker keeps from one task to the next, under one name: see ``kept``.
_kept: dict[object, object] = {}


def kept(name: object, make: Callable[[], object]) -> object:
    """What ``make`` returns, made once in a worker and kept until another operator's task or another name comes."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def tidily(run: Callable, keeps: bool = False) -> Callable:
    """``run`` for ``mapInArrow``, in a worker that serves one stage after the other: what earlier operators keep is dropped
    first (unless ``run`` itself ``keeps``), and memory that was freed goes back to the system at the end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            _kept.clear()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim is not None:
                trim(0)

    task.__name__ = run.__name__  # plans name it
    return task


def text_or_empty(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` (binary or string) holds about ``most_bytes`` at most, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = offsets_of(batch.column(column))
        at, n = 0, batch.num_rows
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1
            to = min(n, max(to, at + 1))
            yield batch.slice(at, to - at)
            at = to


def offsets_of(array: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array, without a copy."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(array.buffers()[1], dtype=kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)


def bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array without nulls, and each row's offsets into them."""
    offsets = offsets_of(array)
    buffer = array.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
