"""Batching sinks for streams: every trigger hands a batch to a writer, reduced to one row per key if asked.

A stream's batches are numbered and replayed with the same number after a
failure, so a writer that replaces by key, or that remembers the last number, writes
each batch in effect once.
"""

from __future__ import annotations

import datetime as dt
import logging
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemill.operators.ordering import parse_keys
from tidemill.operators.windows import keyed_top1

Writer = Callable[[DataFrame, int], None]
log = logging.getLogger("tidemill.sinks")


@dataclass
class KeyedMode:
    """One row of each key in a batch: the largest in the order, or the last to arrive."""

    keys: list[str]
    order: str | None = None
    arrival: str | None = None

    @classmethod
    def from_options(cls, options: dict[str, str]) -> KeyedMode | None:
        """From sink.keyed.mode, sink.keyed.mode.keys and sink.keyed.mode.orderby."""
        if options.get("sink.keyed.mode", "false") != "true":
            return None
        return cls(parse_keys(options.get("sink.keyed.mode.keys", "")), options.get("sink.keyed.mode.orderby"), options.get("sink.keyed.mode.arrival"))

    def reduce(self, batch: DataFrame) -> DataFrame:
        if self.order:
            return keyed_top1(batch, self.keys, self.order, self.arrival)
        if self.arrival:
            return keyed_top1(batch, self.keys, f"{self.arrival} asc")
        return batch.dropDuplicates(self.keys)


def batching_sink(stream: DataFrame, write: Writer, checkpoint: str, interval: str | None = "1 second", keyed: KeyedMode | None = None, before: Callable[[float], None] | None = None, once: bool = False, mode: str | None = None) -> StreamingQuery:
    """Start a query that hands batches to a writer.

    interval is how long rows are gathered; the batch's size is limited by
    the source's options.  before is called ahead of every batch with the time, for upkeep.
    once: take what is there and end.
    """

    def each(batch: DataFrame, number: int) -> None:
        if before:
            before(dt.datetime.now(dt.UTC).timestamp())
        rows = keyed.reduce(batch) if keyed else batch
        began = dt.datetime.now()
        write(rows, number)
        log.info("batch %s written in %s", number, dt.datetime.now() - began)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if mode:
        writer = writer.outputMode(mode)
    return writer.trigger(**({"availableNow": True} if once else {"processingTime": interval})).start()


def routed(routes: dict[str, Writer], discriminator: str) -> Writer:
    """A writer that sends each row to the writer of its discriminator; others are left out."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for value, one in routes.items():
                one(kept.where(F.col(discriminator) == value), number)
        finally:
            kept.unpersist()

    return write


class Periodic:
    """Statements that run once a day, or once on a day of the week (0 is Monday), at or after a time of day."""

    def __init__(self, run: Callable[[list[str]], None], statements: Callable[[float], list[str]], hour: int = 0, minute: int = 0, week_day: int | None = None):
        self.run, self.statements, self.hour, self.minute, self.week_day = run, statements, hour, minute, week_day
        self.last: dt.date | None = None

    def __call__(self, now: float) -> None:
        at = dt.datetime.fromtimestamp(now, dt.UTC)
        due = (at.hour, at.minute) >= (self.hour, self.minute) and at.hour == self.hour and (self.week_day is None or at.weekday() == self.week_day)
        if due and self.last != at.date():
            self.last = at.date()
            self.run(self.statements(now))


class RowBuffer:
    """Rows gathered until there are batch_size of them or interval_ms have passed since the last flush.

    A flush for time is left out if the last one was less than min_pause_ms
    ago.  With key, one row of each key is held, and replace decides between a
    new row and the one held.  An error of flush comes up at once.
    """

    def __init__(self, flush: Callable[[list], None], batch_size: int = 500, interval_ms: float = 1000, min_pause_ms: float = 100, key: Callable | None = None, replace: Callable = lambda new, old: new, clock: Callable[[], float] = time.monotonic):
        if batch_size < 1:
            raise ValueError("batch_size must be positive")
        self.out, self.size, self.interval, self.pause, self.key, self.replace, self.clock = flush, batch_size, interval_ms, min_pause_ms, key, replace, clock
        self.held: dict = {}
        self.last = self.due = clock()

    def add(self, row) -> None:
        k = self.key(row) if self.key else len(self.held)
        self.held[k] = self.replace(row, self.held[k]) if k in self.held else row
        if len(self.held) >= self.size:
            self.flush()
            return
        now = self.clock()
        if (now - self.due) * 1000 >= self.interval:
            self.due = now
            if (now - self.last) * 1000 >= self.pause:
                self.flush()

    def flush(self) -> None:
        rows, self.held = list(self.held.values()), {}
        if rows:
            self.out(rows)
        self.last = self.clock()

    close = flush


def buffered(start: Callable[[], Callable[[list], None]], batch_size: int = 500, interval_ms: float = 1000, min_pause_ms: float = 100, key: Callable | None = None, replace: Callable = lambda new, old: new) -> Writer:
    """A writer whose executors gather the rows of each partition in a RowBuffer; start makes a partition's flush (and its connection)."""

    def write_rows(rows: Iterator) -> None:
        buffer = RowBuffer(start(), batch_size, interval_ms, min_pause_ms, key, replace)
        for row in rows:
            buffer.add(row)
        buffer.close()

    return in_partitions(write_rows)


def in_partitions(write_rows: Callable[[Iterator], None]) -> Writer:
    """A writer that has every partition written by the executors."""

    def write(batch: DataFrame, number: int) -> None:
        batch.foreachPartition(write_rows)

    return write
