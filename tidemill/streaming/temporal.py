"""A join of a stream with the versions of a dimension, as of each row's own time.

Changes of the dimension come as a second stream.  Each key keeps its versions
as state, by the time from which they hold.  A row waits until the watermark
has passed its time, so that no version that holds then can still come, and
leaves with the version of its time.  Versions that no later row can need go.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemill.streaming.stateful import FRAME, Waiting


class _AsOf(StatefulProcessor):
    def __init__(self, key: str, inner: bool, valid_ms: int | None):
        self.key, self.inner, self.valid = key, inner, valid_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.versions = handle.getMapState("versions", "at long", "row string, seq long, gone boolean")
        self.waiting = Waiting(handle)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        watermark = timerValues.getCurrentWatermarkInMs()
        came: list[tuple[int, str]] = []
        new: dict[int, tuple[str, int, bool]] = {}
        for pdf in rows:
            for fact, at, row, seq, gone in zip(pdf["fact"], pdf["time_ms"].astype("int64").tolist(), pdf["row"], pdf["seq"].astype("int64").tolist(), pdf["gone"]):
                if not fact:
                    # Of versions of one time the last by seq holds; a late one holds for rows that still wait or come.
                    if at not in new or seq >= new[at][1]:
                        new[at] = row, seq, bool(gone)
                elif at > watermark:  # rows behind the watermark are dropped
                    came.append((at, row))
        for at, version in new.items():
            held = self.versions.getValue((at,))
            if held is None or version[1] >= held[1]:
                self.versions.updateValue((at,), version)
        self.waiting.add(came)
        if any(at <= watermark for at in new):
            self._forget(self._held(), watermark)
        if new and max(new) > watermark:
            # Where only versions come: old ones go when the watermark has passed the newest.
            self.waiting.wake(max(new))
        return iter(())

    def _held(self) -> list[tuple[int, tuple[str, int, bool]]]:
        """The versions by time."""
        return sorted((at, tuple(version)) for (at,), version in self.versions.iterator()) if self.versions.exists() else []

    def _forget(self, held: list[tuple[int, tuple[str, int, bool]]], at: int) -> None:
        """Versions that don't hold at this time or later go; so does a deletion that nothing came after."""
        old = held[: bisect_right(held, at, key=lambda v: v[0])]
        for t, version in old:
            if t < old[-1][0] or version[2]:
                self.versions.removeKey((t,))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs()
        due, held, out = self.waiting.due(watermark), self._held(), []
        for at, rows in due:
            place = bisect_right(held, at, key=lambda v: v[0])
            since, (version, _, gone) = held[place - 1] if place else (None, (None, 0, True))
            if gone or self.valid is not None and at - since > self.valid:
                since = version = None
            if version is not None or not self.inner:
                out += [{self.key: key[0], "time_ms": at, "row": r, "since_ms": since, "version": version} for r in rows]
        # No row of an earlier time than the watermark's is left.
        self._forget(held, watermark)
        if held and held[-1][0] > watermark:
            self.waiting.wake(held[-1][0])
        for i in range(0, len(out), FRAME):
            yield pd.DataFrame(out[i : i + FRAME], dtype=object)

    def close(self) -> None:
        pass


def temporal_join(facts: DataFrame, versions: DataFrame, key: str, time: str, version_time: str, how: str = "left", seq: str | None = None, deleted: str | None = None, valid_seconds: float | None = None, watermark: str = "5 seconds") -> DataFrame:
    """Each row of a stream with the version of its key that held at the row's own time.

    versions: a stream of changes; each holds from its version_time until the
    next of its key, or for valid_seconds at most.  seq orders versions of one
    time; deleted names a boolean column that tells deletions, from which on
    there is no version.  how: left keeps rows without a version, inner drops them.

    Columns: the key, time_ms, the row and the version as JSON, and since_ms,
    the version's time.  A row leaves when the watermark, the lesser of both
    streams', has passed its time; so a stream that falls silent holds the
    other back.  Rows behind the watermark are dropped.  A version that comes
    late is not given to rows that have left, but to all that still wait or come.
    Null keys never match: their rows leave without a version.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"no join {how!r}")
    kinds = dict(facts.dtypes)

    def tagged(df: DataFrame, at: str, fact: bool) -> DataFrame:
        df = df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, watermark)
        # Rows with a null key may not meet versions with one.
        rows = df if fact else df.where(F.col(key).isNotNull())
        columns = [c for c in df.columns if c != key]
        order = F.lit(0) if fact or not seq else F.col(seq)
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted and not fact else F.lit(False)
        # Late rows are dropped by this column; late versions are not to be, and are judged by time_ms.
        judged = F.col(at) if fact else F.lit("2262-01-01").cast("timestamp")  # the last that pandas takes
        return rows.select(F.col(key).cast(kinds[key]).alias("k"), judged.alias("at"), F.unix_millis(at).alias("time_ms"), F.lit(fact).alias("fact"), F.to_json(F.struct(*columns)).alias("row"), order.cast("long").alias("seq"), gone.alias("gone"))

    both = tagged(facts, time, True).unionByName(tagged(versions, version_time, False))
    processor = _AsOf(key, how == "inner", None if valid_seconds is None else int(valid_seconds * 1000))
    return both.groupBy("k").transformWithStateInPandas(statefulProcessor=processor, outputStructType=f"`{key}` {kinds[key]}, time_ms long, row string, since_ms long, version string", outputMode="Append", timeMode="EventTime")
