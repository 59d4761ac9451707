"""Pieces that several corpus operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class Memo(dict):
    """compute(key) by key, forgotten as a whole once it holds `limit` entries; keys over `longest` are never kept."""

    def __init__(self, compute: Callable[[Any], Any], limit: int = 150_000, longest: int = 48):
        super().__init__()
        self.compute, self.limit, self.longest = compute, limit, longest

    def __missing__(self, key: Hashable) -> Any:
        value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds: the split that decides what a model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def free_name(name: str, taken: Iterable[str]) -> str:
    """name, with lines before it until no column of the caller has it, letter case aside."""
    there = {c.lower() for c in taken}
    while name.lower() in there:
        name = f"_{name}"
    return name


_KEPT: dict[str, Any] = {}


def give_back() -> None:
    """Freed memory goes back to the system, that of Arrow and, where the C library can do it, all other."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)


def kept(name: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: that of one operator at a time, as workers are used again."""
    if name not in _KEPT:
        forget()
        _KEPT[name] = make()
    return _KEPT[name]


def forget() -> None:
    """What the worker keeps for an operator goes, for one that needs nothing of the kind or is done."""
    if _KEPT:
        _KEPT.clear()
        give_back()


def forgetting(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, with what workers keep forgotten once a task ends: a worker that waits for its next task holds nothing."""

    def task(batches: Iterator) -> Iterator:
        forget()
        try:
            yield from run(batches)
        finally:
            _KEPT.clear()
            give_back()

    return task


def parts_of(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches, which Spark bounds by bytes, in parts of at most `rows` rows: what Python makes of one stays small."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def by_parts(compute: Callable[[list], list], returns: str, kind: pa.DataType, rows: int = 256) -> Callable[[Column], Column]:
    """A column function from compute(values) -> results, which sees at most `rows` values of a batch at once."""

    @F.arrow_udf(returns)
    def run(values: pa.Array) -> pa.Array:
        done = [pa.array(compute(values.slice(k, rows).to_pylist()), kind) for k in range(0, len(values), rows)]
        return pa.concat_arrays(done) if done else pa.array([], kind)

    return run
