"""Lookup joins against dimensions, and the batch form of wait joins."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A dimension of more rows is refused, unless the caller allows for it; and one of fewer is broadcast.
MAX_ROWS, BROADCAST_ROWS = 100_000, 100_000
#: A dimension of more bytes (as JSON) is not broadcast either.
BROADCAST_BYTES = 64 << 20


def small_enough(dim: DataFrame, rows: int, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table has no more than so many rows and bytes; no more than one row beyond is looked at."""
    found = dim.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes")).first()
    return found["n"] <= rows and found["bytes"] <= size


def lookup_join(left: DataFrame, dim: DataFrame, on: dict[str, str], how: str = "left", null_keys_match: bool = False, broadcast_rows: int = BROADCAST_ROWS, small: bool | None = None) -> DataFrame:
    """Join each row with all rows of the dimension that have its keys.

    on: column of left to column of dim.  The dimension's rows and bytes are
    counted (unless small tells), and it is broadcast if it is small; else both sides are shuffled.  left may be a stream.
    Columns of dim whose name left has too get the prefix dim_.
    """
    clash = {c: f"dim_{c}" for c in dim.columns if c in left.columns}
    renamed = dim.withColumnsRenamed(clash)
    side = F.broadcast(renamed) if (small_enough(dim, broadcast_rows) if small is None else small) else renamed
    conditions: list[Column] = []
    for a, b in on.items():
        right = side[clash.get(b, b)]
        conditions.append(left[a].eqNullSafe(right) if null_keys_match else left[a] == right)
    return left.join(side, reduce(lambda x, y: x & y, conditions), how)


class RefreshedDimension:
    """A dimension that is read again when it is older than its time to live.

    Used in foreachBatch, where each batch asks for the frame that is current.
    A failed reload is tried again, three times in all, before it is an error.
    """

    def __init__(self, read: Callable[[], DataFrame], ttl_seconds: float = 3600, max_rows: int = MAX_ROWS, tries: int = 3, wait_seconds: float = 1.0, clock: Callable[[], float] = time.monotonic):
        self.read, self.ttl, self.max_rows, self.tries, self.wait, self.clock = read, ttl_seconds, max_rows, tries, wait_seconds, clock
        self._frame: DataFrame | None = None
        self._small: bool | None = None  # of the frame, found out by its first join
        self._loaded = 0.0
        self.loads = 0

    def frame(self) -> DataFrame:
        if self._frame is None or self.clock() - self._loaded >= self.ttl:
            fresh = self._load()
            if self._frame is not None:
                self._frame.unpersist()
            self._frame, self._loaded, self._small = fresh, self.clock(), None
            self.loads += 1
        return self._frame

    def _load(self) -> DataFrame:
        for left in range(self.tries - 1, -1, -1):
            try:
                frame = self.read().cache()
                if frame.limit(self.max_rows + 1).count() > self.max_rows:
                    frame.unpersist()
                    raise ValueError(f"the dimension has more than {self.max_rows} rows")
                return frame
            except ValueError:
                raise
            except Exception:
                if not left:
                    raise
                time.sleep(self.wait)
        raise AssertionError

    def join(self, batch: DataFrame, on: dict[str, str], how: str = "left") -> DataFrame:
        frame = self.frame()
        if self._small is None:
            self._small = small_enough(frame, self.max_rows)
        return lookup_join(batch, frame, on, how, small=self._small)


def lateral_explode(df: DataFrame, array: Column, alias: str) -> DataFrame:
    """Each row with each element; rows with a null or empty array stay, with null."""
    return df.select("*", F.explode_outer(array).alias(alias))


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, by the order columns."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in rest])


def wait_join_batch(sides: dict[str, DataFrame], key: str, order: list[str]) -> DataFrame:
    """What a wait join of these streams holds at last: the latest row of every side, side by side per key.

    Columns are named <side>_<column>; a side without the key gives nulls.
    """
    latest = [latest_per_key(df, key, order).select(key, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != key]) for name, df in sides.items()]
    return reduce(lambda a, b: a.join(b, key, "full"), latest)
