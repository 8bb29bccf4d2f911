"""Operators that hand rows to Python in batches: chunks, throttled calls and asynchronous calls."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from queue import Empty, SimpleQueue

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def _arrow(schema: str | T.StructType) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def batch_flat_map(df: DataFrame, function: Callable[[list[dict]], Iterable[dict]], schema: str, batch_size: int = 500) -> DataFrame:
    """function gets lists of up to batch_size rows and gives any number of rows; what is left at the end is handed over too."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    kind = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            held += batch.to_pylist()
            while len(held) >= batch_size:
                yield pa.RecordBatch.from_pylist(list(function(held[:batch_size])), kind)
                held = held[batch_size:]
        if held:
            yield pa.RecordBatch.from_pylist(list(function(held)), kind)

    return df.mapInArrow(run, schema)


def batch_map(df: DataFrame, function: Callable[[list[dict]], list[dict]], schema: str, batch_size: int = 500) -> DataFrame:
    """The same for functions that give one row for each row."""

    def checked(rows: list[dict]) -> list[dict]:
        out = list(function(rows))
        if len(out) != len(rows):
            raise ValueError(f"{len(out)} rows came back for {len(rows)}")
        return out

    return batch_flat_map(df, checked, schema, batch_size)


def async_map(df: DataFrame, function: Callable[[dict], list[dict]], schema: str, capacity: int = 100, timeout: float = 10.0, ordered: bool = False, on_timeout: Callable[[dict], list[dict]] | None = None, start: Callable[[], object] | None = None) -> DataFrame:
    """Call a function for every row, with up to `capacity` calls of a partition under way at once.

    Results leave in the order of rows if ordered, else as they come.  A call
    that takes longer than the timeout fails the job, or gives on_timeout's
    rows.  start makes whatever a worker needs (such as a client), once.
    """

    kind = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = start() if start else None
        call = (lambda row: function(row, tool)) if start else function  # type: ignore[call-arg]
        pool, came = ThreadPoolExecutor(max_workers=capacity), SimpleQueue()

        def submit(row: dict, number: int) -> tuple:
            future = pool.submit(call, row)
            if not ordered:
                future.add_done_callback(lambda _: came.put(number))
            return future, row, time.monotonic()

        def settle(future, row: dict, begun: float) -> list[dict]:
            try:
                return list(future.result(timeout=max(0.0, begun + timeout - time.monotonic())))
            except TimeoutError:
                if on_timeout is None:
                    raise TimeoutError(f"no result within {timeout} s") from None
                return list(on_timeout(row))

        def results(rows: list[dict]) -> Iterator[list[dict]]:
            under_way: dict[int, tuple] = {}  # in the order of their start, so the first is the oldest
            number = 0
            while number < len(rows) or under_way:
                while number < len(rows) and len(under_way) < capacity:
                    under_way[number] = submit(rows[number], number)
                    number += 1
                first = next(iter(under_way))
                if not ordered:
                    try:
                        first = came.get(timeout=max(0.0, under_way[first][2] + timeout - time.monotonic()))
                    except Empty:
                        pass  # the oldest call is out of time
                if first in under_way:  # else a call that was given up has ended
                    yield settle(*under_way.pop(first))

        try:
            for batch in batches:
                out = [r for part in results(batch.to_pylist()) for r in part]
                came = SimpleQueue()
                if out:
                    yield pa.RecordBatch.from_pylist(out, kind)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return df.mapInArrow(run, schema)


class FailAfter:
    """A function for tests of recovery: passes rows on and fails after so many."""

    def __init__(self, rows: int):
        self.rows, self.seen = rows, 0

    def __call__(self, rows: list[dict]) -> list[dict]:
        self.seen += len(rows)
        if self.seen > self.rows:
            raise RuntimeError(f"failed on purpose after {self.rows} rows")
        return rows
