"""Operators that keep state per key, on transformWithStateInPandas.

State lives in the session's state store (RocksDB with the library's
settings) and is part of the query's checkpoint.  Timers fire between
batches, so a delay is kept to within one trigger.  Operators on processing
time wait for their timers: run them with a trigger that goes on, as a run
over "what is there" would not end.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemill.streaming.changelog import ExactSum

#: (new, old) to (replace the kept row, hand the row on).
Gate = Callable[[dict, dict], tuple[bool, bool]]


#: Rows of a frame handed on.
FRAME = 10_000


def always(new: dict, old: dict) -> tuple[bool, bool]:
    return True, True


def unless_equal(new: dict, old: dict) -> tuple[bool, bool]:
    """Take a row only if it differs from the one kept."""
    return (False, False) if new == old else (True, True)


class _Wait(StatefulProcessor):
    """Latest row of each side; complete rows leave at once, partial ones when the delay is over."""

    def __init__(self, sides: list[str], delay_ms: int, ttl_ms: int, gates: dict[str, Gate], key: str):
        self.sides, self.delay, self.ttl, self.gates, self.key = sides, delay_ms, ttl_ms, gates, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "side string", "row string", self.ttl or None)
        self.timer = handle.getValueState("timer", "at long")

    def _held(self) -> dict[str, dict]:
        held = {s: json.loads(self.rows.getValue((s,))[0]) for s in self.sides if self.rows.containsKey((s,))}
        for side, row in held.items():  # reading keeps a row alive: its time to live starts anew
            if self.ttl:
                self.rows.updateValue((side,), (json.dumps(row),))
        return held

    def _out(self, key: Any, held: dict[str, dict]) -> dict:
        return {self.key: key} | {s: json.dumps(held[s]) if s in held else None for s in self.sides}

    def _stop(self) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        held, out = self._held(), []
        for r in sorted((r for pdf in rows for r in pdf.to_dict("records")), key=lambda r: r["seq"]):
            side, new = r["side"], json.loads(r["row"])
            replace, hand_on = self.gates.get(side, always)(new, held[side]) if side in held else (True, True)
            if replace:
                held[side] = new
                self.rows.updateValue((side,), (r["row"],))
            if not (replace and hand_on):
                continue
            if len(held) == len(self.sides):
                out.append(self._out(key[0], held))
                self._stop()
            elif not self.timer.exists():
                at = timerValues.getCurrentProcessingTimeInMs() + self.delay
                self.handle.registerTimer(at)
                self.timer.update((at,))
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.timer.clear()
        held = self._held()
        if 0 < len(held) < len(self.sides):
            yield pd.DataFrame([self._out(key[0], held)])

    def close(self) -> None:
        pass


def wait_join(sides: dict[str, DataFrame], key: str, delay_ms: int = 3000, ttl_ms: int = 60_000, gates: dict[str, Gate] | None = None, seq: str | None = None) -> DataFrame:
    """Join two or more streams by key, waiting for the sides that are missing.

    The latest row of every side is kept (for ttl_ms after it was last used;
    0: for ever).  When all are there, rows of the key leave, and again with
    every later arrival; what is incomplete after delay_ms leaves as it is.
    A gate decides on a row that meets an older one of its side.  Columns: the
    key and one JSON column per side, null for a side that is missing.  seq
    orders the rows of a batch; rows without order come as they are read.
    """
    tagged = [df.select(F.col(key).alias(key), F.lit(name).alias("side"), F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("row"), (F.col(seq).cast("long") if seq else F.monotonically_increasing_id()).alias("seq")) for name, df in sides.items()]
    union = reduce(DataFrame.unionByName, tagged)
    kind = dict(union.dtypes)[key]
    schema = ", ".join([f"{key} {kind}", *[f"{s} string" for s in sides]])
    return union.groupBy(key).transformWithStateInPandas(statefulProcessor=_Wait(list(sides), delay_ms, ttl_ms, gates or {}, key), outputStructType=schema, outputMode="Update", timeMode="ProcessingTime")


class _Throttle(StatefulProcessor):
    def __init__(self, interval_ms: int, eager: bool, newer: Callable[[dict, dict], bool], key: str):
        self.interval, self.eager, self.newer, self.key = interval_ms, eager, newer, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", "row string")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        for r in sorted((r for pdf in rows for r in pdf.to_dict("records")), key=lambda r: r["seq"]):
            waiting = self.timer.exists()
            if self.eager and not waiting:
                out.append({self.key: key[0], "row": r["row"]})
            elif not self.row.exists() or self.newer(json.loads(r["row"]), json.loads(self.row.get()[0])):
                self.row.update((r["row"],))
            if not waiting:
                at = timerValues.getCurrentProcessingTimeInMs() + self.interval
                self.handle.registerTimer(at)
                self.timer.update((at,))
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.timer.clear()
        if self.row.exists():
            held = self.row.get()[0]
            self.row.clear()
            yield pd.DataFrame([{self.key: key[0], "row": held}])

    def close(self) -> None:
        pass


def throttle(stream: DataFrame, key: str, interval_ms: int, eager: bool = True, newer: Callable[[dict, dict], bool] = lambda new, old: True, seq: str | None = None) -> DataFrame:
    """At most one row of each key in an interval: the newest.

    eager: the first row leaves at once, and the newest of those after it when
    the interval ends; else nothing leaves before.  After an interval's end
    the next row is a first one again.  Columns: the key, and the row as JSON.
    """
    tagged = stream.select(key, F.to_json(F.struct(*[c for c in stream.columns if c != key])).alias("row"), (F.col(seq).cast("long") if seq else F.monotonically_increasing_id()).alias("seq"))
    kind = dict(stream.dtypes)[key]
    return tagged.groupBy(key).transformWithStateInPandas(statefulProcessor=_Throttle(interval_ms, eager, newer, key), outputStructType=f"{key} {kind}, row string", outputMode="Update", timeMode="ProcessingTime")


class _History(StatefulProcessor):
    def __init__(self, value: str, ttl_ms: int, key: str):
        self.value, self.ttl, self.key = value, ttl_ms, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "value string", self.ttl or None)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            for v in pdf[self.value]:
                self.held.appendValue((None if v is None else str(v),))
        values = [r[0] for r in self.held.get()]
        yield pd.DataFrame([{self.key: key[0], "n": len(values), "history": values}])

    def close(self) -> None:
        pass


def history(stream: DataFrame, key: str, value: str, ttl_ms: int = 10_000) -> DataFrame:
    """All values that each key had within the time to live, with every batch that has new ones."""
    kind = dict(stream.dtypes)[key]
    return stream.select(key, value).groupBy(key).transformWithStateInPandas(statefulProcessor=_History(value, ttl_ms, key), outputStructType=f"{key} {kind}, n long, history array<string>", outputMode="Update", timeMode="ProcessingTime")


def _unique(values: list) -> list:
    return list({json.dumps(v, sort_keys=True): v for v in values}.values())


def _whole(kind: str) -> bool:
    return kind in ("tinyint", "smallint", "int", "bigint")


#: Aggregates of a frame (nulls left out): how they are kept, and their type from the column's.  Those kept as a list cost as much as their result is long.
FRAME_FUNCTIONS: dict[str, tuple[str, Callable[[str], str]]] = {
    "count": ("count", lambda kind: "long"),
    "count_distinct": ("distinct", lambda kind: "long"),
    "sum": ("sum", lambda kind: "long" if _whole(kind) else "double"),
    "avg": ("sum", lambda kind: "double"),
    "max": ("stack", lambda kind: kind),
    "min": ("stack", lambda kind: kind),
    "first": ("stack", lambda kind: kind),
    "last": ("stack", lambda kind: kind),
    "collect": ("list", lambda kind: f"array<{kind}>"),
    "collect_distinct": ("list", lambda kind: f"array<{kind}>"),
    "listagg": ("list", lambda kind: "string"),
}
#: Of an older and a later value, neither null, the one that stays.
_STAYS: dict[str, Callable[[Any, Any], Any]] = {"max": lambda a, b: max(a, b), "min": lambda a, b: min(a, b), "first": lambda a, b: a, "last": lambda a, b: b}


class Waiting:
    """The rows of a key that wait for the watermark, as a list, and one timer: for the earliest of them, or for what else is to be done."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle = handle
        self.rows = handle.getListState("waiting", "at long, row string")
        self.timer = handle.getValueState("timer", "at long")

    def wake(self, at: int) -> None:
        """Set the timer, unless it is set to an earlier time."""
        if self.timer.exists():
            before = self.timer.get()[0]
            if before <= at:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def add(self, rows: list[tuple[int, str]]) -> None:
        if rows:
            self.rows.appendList(rows)
            self.wake(min(at for at, _ in rows))

    def due(self, watermark: int) -> list[tuple[int, list[str]]]:
        """When the timer has expired: the rows that the watermark has reached, by time; the others go on waiting."""
        self.timer.clear()
        out: dict[int, list[str]] = {}
        left = []
        for at, row in self.rows.get() if self.rows.exists() else ():
            if at <= watermark:
                out.setdefault(at, []).append(row)
            else:
                left.append((at, row))
        if left:
            if out:
                self.rows.put(left)
            self.wake(min(at for at, _ in left))
        elif out:
            self.rows.clear()
        return sorted(out.items())


class _Frame:
    """The rows of a range by time, with aggregates that follow as times come and go.

    Times are a linked list of buckets in a map state.  Counts and sums are
    added and taken back (sums exactly).  Of what can't be taken back there are
    two stacks: the older buckets hold the aggregate from them to the younger
    end of their stack, the younger ones one for all of them; when the older
    stack runs out the younger one is turned over.  So a time costs the same,
    however long the frame is, but for results that are lists of the frame.

    From load to save what is read and changed is kept here, so that a time
    that comes and goes between the two costs the state nothing.
    """

    def __init__(self, handle: StatefulProcessorHandle, aggregates: dict[str, tuple[str, str]], kinds: dict[str, str]):
        self.aggregates, self.kinds = aggregates, kinds
        kept = lambda *how: sorted({c for f, c in aggregates.values() if FRAME_FUNCTIONS[f][0] in how and c != "*"})
        self.counted, self.summed, self.told_apart = kept("count", "sum", "distinct", "stack", "list"), kept("sum"), kept("distinct")
        self.stacks = [(f, c) for f, c in aggregates.values() if FRAME_FUNCTIONS[f][0] == "stack"]
        self.lists = any(FRAME_FUNCTIONS[f][0] == "list" for f, _ in aggregates.values())
        self.buckets = handle.getMapState("buckets", "at long", "next long, held string, front string")
        self.values = handle.getMapState("values", "name string, value string", "n long")
        self.state = handle.getValueState("frame", "frame string")

    def load(self) -> None:
        empty = {"head": None, "tail": None, "flip": None, "back": None, "n": 0, "count": {}, "sum": {}, "distinct": {}}
        self.now = json.loads(self.state.get()[0]) if self.state.exists() else empty
        # Of times and of (column, value): whether the state has it, what it is to hold (None: nothing), and what was read.
        self.was: dict[Any, bool] = {}
        self.near: dict[Any, Any] = {}
        self.seen: dict[Any, Any] = {}

    def save(self) -> None:
        for place, value in self.near.items():
            state, key = (self.values, place) if isinstance(place, tuple) else (self.buckets, (place,))
            if value is None:
                if self.was[place]:
                    state.removeKey(key)
            elif state is self.values:
                state.updateValue(key, (value,))
            else:
                following, held, front = value
                state.updateValue(key, (following, json.dumps(held), json.dumps(front) if front is not None else None))
        self.near, self.seen = {}, {}
        if self.now["head"] is None:
            self.state.clear()
        else:
            self.state.update((json.dumps(self.now),))

    def _bucket(self, at: int) -> tuple[int | None, dict, list | None]:
        if at in self.near:
            return self.near[at]
        if at not in self.seen:
            following, held, front = tuple(self.buckets.getValue((at,)))
            self.seen[at] = following, json.loads(held), json.loads(front) if front else None
            self.was[at] = True
        return self.seen[at]

    def _put(self, at: int, following: int | None, held: dict, front: list | None) -> None:
        self.was.setdefault(at, False)
        self.near[at] = following, held, front

    def _held(self, place: tuple[str, str]) -> int:
        """How often a value is in the frame."""
        if place in self.near:
            return self.near[place] or 0
        if place not in self.seen:
            self.was[place] = self.values.containsKey(place)
            self.seen[place] = self.values.getValue(place)[0] if self.was[place] else 0
        return self.seen[place]

    def _both(self, older: list | None, later: list | None) -> list | None:
        if older is None or later is None:
            return later if older is None else older
        return [a if b is None else b if a is None else _STAYS[f](a, b) for (f, _), a, b in zip(self.stacks, older, later)]

    def _own(self, held: dict) -> list:
        of = lambda f, v: None if not v else v[0] if f == "first" else v[-1] if f == "last" else (max if f == "max" else min)(v)
        return [of(f, held["values"].get(c, [])) for f, c in self.stacks]

    def _count(self, held: dict, sign: int) -> None:
        now = self.now
        now["n"] += sign * held["n"]
        for c in self.counted:
            now["count"][c] = now["count"].get(c, 0) + sign * len(held["values"].get(c, []))
        for c in self.summed:
            if _whole(self.kinds[c]):
                now["sum"][c] = now["sum"].get(c, 0) + sign * sum(held["values"].get(c, []))
            else:
                exact = ExactSum(*now["sum"].get(c, ([], [0, 0, 0])))
                for v in held["values"].get(c, []):
                    exact.add(float(v), sign)
                now["sum"][c] = [exact.partials, exact.strange]
        for c in self.told_apart:
            change: dict[str, int] = {}
            for v in held["values"].get(c, []):
                text = json.dumps(v, sort_keys=True)
                change[text] = change.get(text, 0) + sign
            for text, d in change.items():
                before = self._held((c, text))
                self.near[c, text] = before + d or None
                now["distinct"][c] = now["distinct"].get(c, 0) + (before + d > 0) - (before > 0)

    def add(self, at: int, rows: list[str]) -> None:
        """The rows of a time after all times held."""
        parsed = [json.loads(r) for r in rows]
        held = {"n": len(parsed), "values": {c: [r[c] for r in parsed if r.get(c) is not None] for c in self.counted}}
        now = self.now
        if now["tail"] is not None:
            _, before, front = self._bucket(now["tail"])
            self._put(now["tail"], at, before, front)
        self._put(at, None, held, None)
        now["head"], now["tail"] = at if now["head"] is None else now["head"], at
        if self.stacks:
            now["back"] = self._both(now["back"], self._own(held))
        self._count(held, 1)

    def drop(self, before: int) -> None:
        """Times before this one leave."""
        now = self.now
        while now["head"] is not None and now["head"] < before:
            following, held, _ = self._bucket(now["head"])
            self.near[now["head"]] = None
            self._count(held, -1)
            now["head"] = following
            if following is None:
                now |= {"tail": None, "flip": None, "back": None}
            elif self.stacks and (now["flip"] is None or following > now["flip"]):
                self._turn(following)

    def _turn(self, at: int | None) -> None:
        young = []
        while at is not None:
            following, held, _ = self._bucket(at)
            young.append((at, following, held))
            at = following
        later = None
        for at, following, held in reversed(young):
            later = self._both(self._own(held), later)
            self._put(at, following, held, later)
        self.now |= {"flip": young[-1][0], "back": None}

    def results(self) -> dict[str, Any]:
        now, stacked, lists = self.now, {}, {}
        if self.stacks:
            front = self._bucket(now["head"])[2] if now["flip"] is not None and now["head"] <= now["flip"] else None
            stacked = dict(zip(self.stacks, self._both(front, now["back"]) or []))
        if self.lists:
            at = now["head"]
            while at is not None:
                at, held, _ = self._bucket(at)
                for c, v in held["values"].items():
                    lists.setdefault(c, []).extend(v)
        out = {}
        for name, (function, column) in self.aggregates.items():
            n = now["n"] if column == "*" else now["count"].get(column, 0)
            if function == "count":
                out[name] = n
            elif function == "count_distinct":
                out[name] = now["distinct"].get(column, 0)
            elif function in ("sum", "avg"):
                held = now["sum"].get(column)
                total = None if not n else held if _whole(self.kinds[column]) else ExactSum(*held).value()
                out[name] = total / n if n and function == "avg" else total
            elif (function, column) in stacked:
                out[name] = stacked[function, column]
            else:
                values = lists.get(column, [])
                out[name] = ",".join(map(str, values)) if function == "listagg" else _unique(values) if function == "collect_distinct" else values
        return out


class _Rolling(StatefulProcessor):
    """A frame per key.

    Event time: a row's result leaves when the watermark has passed it, so
    that none of its peers can come.  Processing time: it leaves at once, and
    the rows of a batch are peers.
    """

    def __init__(self, key: str, range_ms: int, aggregates: dict[str, tuple[str, str]], kinds: dict[str, str], event_time: bool):
        self.key, self.range, self.aggregates, self.kinds, self.event_time = key, range_ms, aggregates, kinds, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frame = _Frame(handle, self.aggregates, self.kinds)
        self.waiting = Waiting(handle)

    def _rows(self, key: Any, at: int, rows: list[str]) -> list[dict]:
        values = self.frame.results()
        return [{self.key: key[0], "time_ms": at, "row": row} | values for row in rows]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.event_time:
            now = timerValues.getCurrentProcessingTimeInMs()
            new = [r for pdf in rows for r in pdf["row"]]
            self.frame.load()
            self.frame.drop(now - self.range)
            # Two batches of one millisecond are a millisecond apart.
            self.frame.add(max(now, (self.frame.now["tail"] or 0) + 1), new)
            self.frame.save()
            yield pd.DataFrame(self._rows(key, now, new), dtype=object)
            return
        watermark = timerValues.getCurrentWatermarkInMs()
        # Later rows are dropped.
        self.waiting.add([(at, row) for pdf in rows for at, row in zip(pdf["time_ms"].astype("int64").tolist(), pdf["row"]) if at > watermark])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs()
        due = self.waiting.due(watermark)
        self.frame.load()
        out: list[dict] = []
        for at, rows in due:
            self.frame.drop(at - self.range)
            self.frame.add(at, rows)
            out += self._rows(key, at, rows)
            if len(out) >= FRAME:
                yield pd.DataFrame(out, dtype=object)
                out = []
        # Rows that no row to come can have in its frame leave, though no others come.
        self.frame.drop(watermark - self.range)
        self.frame.save()
        if self.frame.now["tail"] is not None:
            self.waiting.wake(self.frame.now["tail"] + self.range + 1)
        if out:
            yield pd.DataFrame(out, dtype=object)

    def close(self) -> None:
        pass


def rolling_stream(stream: DataFrame, key: str, time: str | None, range_seconds: float, aggregates: dict[str, tuple[str, str]], watermark: str = "5 seconds") -> DataFrame:
    """For every row aggregates over the rows of its key in the range that ends with it.

    time: the event time column; rows behind the watermark are dropped, rows
    of the same time share a result, and results leave when the watermark has
    passed them.  None: processing time; results leave at once.
    aggregates: name to (one of FRAME_FUNCTIONS, column or `*`).  Columns: the
    key, time_ms, the row as JSON, and the aggregates.  The frame of a key is
    kept as state, for as long as the range; a row costs the same however many
    rows its frame has, but for aggregates that are lists.
    """
    kinds = dict(stream.dtypes)
    for name, (function, column) in aggregates.items():
        if function not in FRAME_FUNCTIONS or column not in kinds and (function, column) != ("count", "*"):
            raise ValueError(f"no aggregate {function}({column}) for {name}")
    columns = sorted({c for _, c in aggregates.values() if c != "*"} | {c for c in stream.columns if c != key})
    row = F.to_json(F.struct(*columns)) if columns else F.lit("{}")
    if time and kinds[time] == "timestamp_ntz":
        stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    timed = stream.withWatermark(time, watermark) if time else stream
    rows = timed.select(key, *([time, F.unix_millis(time).alias("time_ms")] if time else []), row.alias("row"))
    out = ", ".join([f"{key} {kinds[key]}", "time_ms long", "row string", *(f"{name} {FRAME_FUNCTIONS[f][1](kinds.get(c, 'long'))}" for name, (f, c) in aggregates.items())])
    processor = _Rolling(key, int(range_seconds * 1000), aggregates, {c: kinds[c] for _, c in aggregates.values() if c != "*"}, time is not None)
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Append" if time else "Update", timeMode="EventTime" if time else "ProcessingTime")
