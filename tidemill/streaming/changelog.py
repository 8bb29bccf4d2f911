"""Change logs of streams: aggregates that take rows back, and the latest row of each key.

A change log is a stream of rows with an op: +I and -D for rows of new and
gone keys, -U and +U for the two halves of an update.  Each operator keeps its
state by key and the row that it last gave, and gives a change for each
micro-batch in which that row has changed.  Operators can be chained, so that
an aggregate over the latest rows takes back what a later row replaces.  Keys
are dealt over groups and Python is called once for a group of a batch.  A
batch's rows come to it packed, one row for each group that a task has read,
and the states of a group's keys stand in pages of a few dozen keys, each read
and written once if a key in it has rows.  By choice each key's state has a
row of its own, which Spark's state reader can show.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator
from decimal import Decimal
from itertools import repeat
from operator import mul
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Aggregates that can take a row back.
FUNCTIONS = ("count", "sum", "avg", "min", "max", "count_distinct")
#: Whether an op adds its row or takes it back.
SIGNS = {"+I": 1, "+U": 1, "-U": -1, "-D": -1}


def grown(partials: list[float], x: float) -> list[float]:
    """A sum kept as doubles that don't overlap, with x added: exact, so that taking a value back leaves no trace."""
    out = []
    for y in partials:
        if abs(x) < abs(y):
            x, y = y, x
        total = x + y
        rest = y - (total - x)
        if rest:
            out.append(rest)
        x = total
    return [*out, x] if x else out


class ExactSum:
    """A sum of doubles from which values can be taken back; NaN and infinities are counted apart."""

    def __init__(self, partials: list[float] | None = None, strange: list[int] | None = None):
        self.partials, self.strange = list(partials or []), list(strange or [0, 0, 0])

    def add(self, x: float, sign: int = 1) -> None:
        if math.isfinite(x):
            self.partials = grown(self.partials, sign * x)
        else:
            self.strange[0 if math.isnan(x) else 1 if x > 0 else 2] += sign

    def value(self) -> float:
        nan, up, down = self.strange
        if nan or up and down:
            return math.nan
        return math.inf if up else -math.inf if down else math.fsum(self.partials)


def _plain(value: Any) -> Any:
    """A value of a pandas row as a state takes it; None for null."""
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    return value.item() if hasattr(value, "item") else value.to_pydatetime() if isinstance(value, pd.Timestamp) else value


#: Keys are dealt over so many groups; Python is called once for each group of a batch, not once for each key.  A call costs some milliseconds besides its rows.
GROUPS = 512
#: So many values of a set stay in their key's own row; longer sets are dealt over parts of about as many.
PART = 256
#: So many keys' states stand in a page at most, on average.
PAGE = 64
#: The page that holds how many pages and keys a group has.
HEAD = -1
#: Rows of a frame handed on.
FRAME = 10_000
#: Rows, and bytes of them, that a task packs at once.
PACKED_ROWS, PACKED_BYTES = 250_000, 32 << 20


def _listed(column: pa.ChunkedArray) -> list:
    """A column's values as a state takes them: no negative nought, times by the session's clock."""
    if pa.types.is_floating(column.type):
        column = pc.add(column, pa.scalar(0.0, column.type))
    elif pa.types.is_timestamp(column.type) and column.type.tz:
        column = pc.local_timestamp(column)
    # The quick way, where it makes no other values of them.
    plain = pa.types.is_string(column.type) or not column.null_count and (pa.types.is_integer(column.type) or pa.types.is_floating(column.type))
    return column.to_numpy().tolist() if plain else column.to_pylist()


def _packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    groups = table["row_group"].to_numpy()
    order = np.argsort(groups, kind="stable")
    groups, table = groups[order], table.drop_columns(["row_group"]).take(order)
    starts = np.flatnonzero(np.diff(groups, prepend=-1))
    columns = {c: _listed(table[c]) for c in table.column_names}
    ends = [*starts[1:].tolist(), len(groups)]
    packed = [pickle.dumps({c: values[a:b] for c, values in columns.items()}, 5) for a, b in zip(starts.tolist(), ends)]
    return pa.RecordBatch.from_arrays([pa.array(groups[starts], pa.int32()), pa.array(packed, pa.binary())], names=["row_group", "packed"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each group among the rows, which holds the group's rows in their order: what a row costs on its way into a Python call is paid once a group."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= PACKED_ROWS or size >= PACKED_BYTES:
            yield _packed(held)
            held, rows, size = [], 0, 0
    if rows:
        yield _packed(held)


def _by_group(df: DataFrame, keys: list[str], values: list[str], groups: int, op: Column | None = None) -> DataFrame:
    """The keys' groups with their rows, packed: keys as key0, ..., values as value0, ..., and the op if there is one."""
    named = [F.col(c).alias(f"{side}{i}") for side, columns in (("key", keys), ("value", values)) for i, c in enumerate(columns)]
    rows = df.select(F.pmod(F.hash(*keys), F.lit(groups)).alias("row_group"), *named, *([op.alias("row_op")] if op is not None else []))
    return rows.mapInArrow(_pack, "row_group int, packed binary")


def _columns(frames: list[pd.DataFrame], names: list[str]) -> dict[str, list]:
    """The values of frames' rows, packed or as they are, by column; of the names those that there are."""
    out: dict[str, list] = {}
    for pdf in frames:
        for part in map(pickle.loads, pdf["packed"]) if "packed" in pdf else [{c: _values(pdf, c) for c in names if c in pdf}]:
            for c, values in part.items():
                real = isinstance(next((v for v in values if v is not None), None), float)
                out.setdefault(c, []).extend([math.nan if v != v else v for v in values] if real else values)
    return out


def _values(pdf: pd.DataFrame, name: str) -> list:
    """A column's values, None for null, one NaN for all; null_ and its name tells which of its numbers are null, as pandas makes nulls NaN."""
    column = pdf[name]
    if f"null_{name}" in pdf:
        values = column.to_numpy().tolist()
        if column.dtype.kind == "f":
            values = [math.nan if v != v else v + 0.0 for v in values]
        return [None if null else v for v, null in zip(values, pdf[f"null_{name}"])]
    return [v if v is None or type(v) is str else _plain(v) for v in column]


def _same(a: Any, b: Any) -> bool:
    return a == b or a != a and b != b


def _order(v: Any) -> tuple:
    """Nulls first, NaN last."""
    return (False, False, 0) if v is None else (True, v != v, 0 if v != v else v)


class _Changing(StatefulProcessor):
    """The rows of a group's keys, each with the row that its key last gave, and the change from it to the next."""

    columns: list[str]
    keys: list[str]
    update_before: bool

    def _init_rows(self, handle: StatefulProcessorHandle, keys: str, schema: str) -> None:
        self.rows = handle.getMapState("rows", keys, schema)

    def _begin(self) -> None:
        """Before a call's first key."""

    def _held(self, key: tuple) -> tuple | None:
        return self.rows.getValue(key)

    def _keep(self, key: tuple, state: tuple) -> None:
        self.rows.updateValue(key, state)

    def _drop(self, key: tuple) -> None:
        self.rows.removeKey(key)

    def _end(self) -> None:
        """After a call's last key."""

    def _rows(self, frames: Iterator[pd.DataFrame], values: int) -> tuple[dict[tuple, list[int]], list[list], list[str] | None]:
        """The numbers of each key's rows, the rows' values by column, and their ops if they have any."""
        keys, named = [f"key{i}" for i in range(len(self.keys))], [f"value{i}" for i in range(values)]
        columns = _columns(list(frames), [*keys, *named, "row_op"])
        by_key: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(*(columns[c] for c in keys))):
            by_key.setdefault(key, []).append(i)
        return by_key, [columns[c] for c in named], columns.get("row_op")

    def _change(self, key: tuple, old: tuple | None, new: tuple | None) -> list[tuple]:
        same = old is not None and new is not None and all(_same(a, b) for a, b in zip(old, new))
        if same or old is None and new is None:
            return []
        rows = [("-D", old)] if new is None else [("+I", new)] if old is None else [("-U", old), ("+U", new)][0 if self.update_before else 1 :]
        return [(op, *key, *row) for op, row in rows]

    def _out(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        for i in range(0, len(rows), FRAME):
            yield pd.DataFrame(rows[i : i + FRAME], columns=["op", *self.keys, *self.columns], dtype=object)

    def close(self) -> None:
        pass


class _Paged:
    """In place of a row for each key: pages of a group's keys, dealt by key, whose number doubles as the group grows."""

    def _init_rows(self, handle: StatefulProcessorHandle, keys: str, schema: str) -> None:
        self.rows = handle.getMapState("pages", "page int", "held binary")

    def _begin(self) -> None:
        head = self.rows.getValue((HEAD,))
        self.count, self.n = self.head = pickle.loads(head[0]) if head else (1, 0)
        self.open: dict[int, dict] = {}
        self.changed: set[int] = set()

    def _number(self, key: tuple) -> int:
        return zlib.crc32(repr(key).encode()) % self.count

    def _read(self, number: int) -> dict:
        held = self.rows.getValue((number,)) if self.n else None
        page = pickle.loads(held[0]) if held else {}
        # A NaN is only found by itself.
        return {tuple(math.nan if v != v else v for v in key): state for key, state in page.items()} if any(v != v for key in page for v in key) else page

    def _write(self, number: int, page: dict) -> None:
        self.rows.updateValue((number,), (pickle.dumps(page, 5),)) if page else self.rows.removeKey((number,))

    def _page(self, number: int) -> dict:
        if number not in self.open:
            self.open[number] = self._read(number)
        return self.open[number]

    def _held(self, key: tuple) -> tuple | None:
        return self._page(self._number(key)).get(key)

    def _keep(self, key: tuple, state: tuple) -> None:
        page = self._page(number := self._number(key))
        self.n += key not in page
        page[key] = state
        self.changed.add(number)

    def _drop(self, key: tuple) -> None:
        del self._page(number := self._number(key))[key]
        self.n -= 1
        self.changed.add(number)

    def _end(self) -> None:
        before = self.count
        while self.n > PAGE * self.count:
            self.count *= 2
        if not self.n:
            self.count = 1
        if self.count > before:
            for number in range(before):
                page, dealt = self.open.pop(number) if number in self.open else self._read(number), {}
                for key, state in page.items():
                    dealt.setdefault(self._number(key), {})[key] = state
                for part in sorted({number, *dealt}):
                    if part in dealt or page:
                        self._write(part, dealt.get(part, {}))
        else:
            for number in sorted(self.changed):
                self._write(number, self.open[number])
        if (self.count, self.n) != self.head:
            self.rows.updateValue((HEAD,), (pickle.dumps((self.count, self.n), 5),)) if self.n else self.rows.removeKey((HEAD,))
        self.open, self.changed = {}, set()


class _Sum:
    """Of a column: how many values aren't null; where it is added up (kind), their sum as a whole number or as doubles, and how many are strange."""

    def __init__(self, kind: T.DataType | None, held: list | None):
        self.whole, self.real = isinstance(kind, WHOLE), isinstance(kind, (T.FloatType, T.DoubleType))
        self.n, *total = held or (0,)
        self.total, self.exact = int(total[0]) if self.whole and total else 0, ExactSum(*total) if self.real else None

    @staticmethod
    def schema(i: int, kind: T.DataType | None) -> str:
        return f"n{i} long" + ("" if kind is None else f", total{i} decimal(38,0)" if isinstance(kind, WHOLE) else f", total{i} array<double>, strange{i} array<long>")

    @staticmethod
    def wide(kind: T.DataType | None) -> int:
        return 1 if kind is None else 2 if isinstance(kind, WHOLE) else 3

    def add(self, values: list, signs: list[int] | None) -> None:
        """signs: None if all are added."""
        self.n += len(values) if signs is None else sum(signs)
        if self.whole:
            self.total += sum(values if signs is None else map(mul, values, signs))
        elif self.real:
            for v, sign in zip(values, signs or repeat(1)):
                self.exact.add(v, sign)

    def value(self) -> Any:
        return self.total if self.whole else self.exact.value()

    def held(self) -> tuple:
        return (self.n, Decimal(self.total)) if self.whole else (self.n, self.exact.partials, self.exact.strange) if self.real else (self.n,)


class _Set:
    """Of a column: how many distinct values there are, the least and the greatest, and how often each value is held.

    A short set stands in its key's row.  A long one is dealt by value over
    parts, whose number doubles as it grows, so that a change reads and writes
    a few hundred values however long the set is, and many changes of a batch
    share that.
    """

    def __init__(self, held: list | None):
        self.n, self.low, self.high, self.parts, values, counts = held or (0, None, None, 0, [], [])
        self.items = dict(zip(values, counts))

    @staticmethod
    def schema(i: int, kind: str) -> str:
        return f"kinds{i} long, low{i} {kind}, high{i} {kind}, parts{i} int, held{i} array<{kind}>, counts{i} array<long>"

    @staticmethod
    def part(v: Any, parts: int) -> int:
        return zlib.crc32(repr(v).encode()) % parts

    def read(self, state: Any, key: tuple, part: int) -> dict:
        held = state.getValue((*key, part))
        return dict(zip([math.nan if v != v else v for v in held[0]], held[1])) if held else {}

    @staticmethod
    def write(state: Any, key: tuple, part: int, items: dict) -> None:
        state.updateValue((*key, part), (list(items), list(items.values())))

    def _apply(self, items: dict, change: dict) -> set:
        """Take changes over; the values that are gone."""
        gone = set()
        for v, d in change.items():
            before = items.get(v, 0)
            after = before + d
            self.n += (after > 0) - (before > 0)
            if after:
                # A value taken back before it came counts below nought until it comes.
                items[v] = after
            else:
                del items[v]
            if after > 0:
                self.widen(v)
            elif before > 0:
                gone.add(v)
        return gone

    def widen(self, v: Any) -> None:
        if self.low is None or _order(v) < _order(self.low):
            self.low = v
        if self.high is None or _order(v) > _order(self.high):
            self.high = v

    def widen_all(self, values: list) -> None:
        real = [v for v in values if v == v]
        if real:
            self.widen(min(real))
            self.widen(max(real))
        if len(real) < len(values):
            self.widen(math.nan)

    def add(self, state: Any, key: tuple, change: dict) -> None:
        """change: by how many each value is held more, or less if below nought."""
        change = {v: d for v, d in change.items() if d}
        if not self.parts:
            gone = self._apply(self.items, change)
            if len(self.items) > PART:
                self._deal(state, key, self.items, 2)
                self.items = {}
        else:
            dealt: dict[int, dict] = {}
            for v, d in change.items():
                dealt.setdefault(self.part(v, self.parts), {})[v] = d
            gone, longest = set(), 0
            for part, some in dealt.items():
                items = self.read(state, key, part)
                gone |= self._apply(items, some)
                self.write(state, key, part, items)
                longest = max(longest, len(items))
            if longest > 4 * PART:
                every = {v: c for part in range(self.parts) for v, c in self.read(state, key, part).items()}
                self._deal(state, key, every, self.parts)
        if any(_same(v, end) for v in gone for end in (self.low, self.high)):  # only then is the whole set read
            self.low = self.high = None
            for part in range(max(self.parts, 1)):
                for v, c in (self.read(state, key, part) if self.parts else self.items).items():
                    if c > 0:
                        self.widen(v)

    def _deal(self, state: Any, key: tuple, items: dict, parts: int) -> None:
        while len(items) > PART * parts:
            parts *= 2
        dealt: dict[int, dict] = {part: {} for part in range(parts)}
        for v, c in items.items():
            dealt[self.part(v, parts)][v] = c
        for part, some in dealt.items():
            self.write(state, key, part, some)
        self.parts = parts

    def clear(self, state: Any, key: tuple) -> None:
        for part in range(self.parts):
            state.removeKey((*key, part))

    def held(self) -> tuple:
        return self.n, self.low, self.high, self.parts, list(self.items), list(self.items.values())


class _Group(_Changing):
    def __init__(self, keys: list[str], key_schema: str, aggregates: dict[str, tuple[str, str]], kinds: dict[str, T.DataType], out: dict[str, T.DataType], update_before: bool, back: bool):
        self.keys, self.key_schema, self.aggregates, self.kinds, self.update_before, self.back = keys, key_schema, aggregates, kinds, update_before, back
        self.columns = list(aggregates)
        self.values = sorted({c for f, c in aggregates.values() if c != "*"})
        self.added = {c: kinds[c] for f, c in aggregates.values() if f in ("sum", "avg")}
        self.counted = sorted({c for f, c in aggregates.values() if c != "*" and f in ("count", "sum", "avg")})
        self.sets = sorted({c for f, c in aggregates.values() if f in ("min", "max", "count_distinct")})
        # Where nothing is taken back, least and greatest values need no set.
        self.whole_sets = {c for f, c in aggregates.values() if f == "count_distinct" or back and f in ("min", "max")}
        self.last = ", ".join(f"last{i} {kind.simpleString()}" for i, kind in enumerate(out.values()))

    def init(self, handle: StatefulProcessorHandle) -> None:
        sums = [_Sum.schema(i, self.added.get(c)) for i, c in enumerate(self.counted)]
        sets = [_Set.schema(i, self.kinds[c].simpleString()) for i, c in enumerate(self.sets)]
        self._init_rows(handle, self.key_schema, ", ".join(["n long, given boolean", self.last, *sums, *sets]))
        self.parts = {c: handle.getMapState(f"parts_{i}", f"{self.key_schema}, part int", f"held array<{self.kinds[c].simpleString()}>, counts array<long>") for i, c in enumerate(self.sets)}

    def _row(self, n: int, sums: dict[str, _Sum], sets: dict[str, _Set]) -> tuple:
        row: list[Any] = []
        for function, column in self.aggregates.values():
            if function == "count":
                row.append(n if column == "*" else sums[column].n)
            elif function in ("sum", "avg"):
                count, total = sums[column].n, sums[column].value()
                row.append(None if not count else total if function == "sum" else total / count)
            else:
                row.append(getattr(sets[column], {"count_distinct": "n", "min": "low", "max": "high"}[function]))
        return tuple(row)

    def _state(self, key: tuple) -> tuple[int, tuple | None, dict[str, _Sum], dict[str, _Set], bool]:
        """Rows, the row last given, sums, sets, and whether the key has a state."""
        state = self._held(key)
        if state is None:
            return 0, None, {c: _Sum(self.added.get(c), None) for c in self.counted}, {c: _Set(None) for c in self.sets}, False
        state = list(state)
        at = 2 + len(self.columns)
        last, sums, sets = tuple(state[2:at]) if state[1] else None, {}, {}
        for c in self.counted:
            wide = _Sum.wide(self.added.get(c))
            sums[c] = _Sum(self.added.get(c), state[at : at + wide])
            at += wide
        for c in self.sets:
            held = state[at : at + 6]
            sets[c] = _Set([*held[:4], [math.nan if v != v else v for v in held[4]], held[5]])
            at += 6
        return state[0], last, sums, sets, True

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        by_key, columns, ops = self._rows(rows, len(self.values))
        signs = None if ops is None else [SIGNS[op] for op in ops]
        out: list[tuple] = []
        self._begin()
        for one, at in by_key.items():
            n, last, sums, sets, there = self._state(one)
            n += len(at) if signs is None else sum(signs[i] for i in at)
            for c, values in zip(self.values, columns):
                some = [v for i in at if (v := values[i]) is not None]
                by = None if signs is None else [signs[i] for i in at if values[i] is not None]
                if c in sums:
                    sums[c].add(some, by)
                if c in self.whole_sets:
                    change: dict[Any, int] = {}
                    for v, sign in zip(some, by or repeat(1)):
                        change[v] = change.get(v, 0) + sign
                    sets[c].add(self.parts[c], one, change)
                elif c in sets:
                    sets[c].widen_all(some)
            new = self._row(n, sums, sets) if n > 0 else None
            out += self._change(one, last, new)
            if n:
                empty = tuple(None for _ in self.columns)
                self._keep(one, (n, new is not None, *(new or empty), *(x for c in self.counted for x in sums[c].held()), *(x for c in self.sets for x in sets[c].held())))
            else:
                for c in self.sets:
                    sets[c].clear(self.parts[c], one)
                if there:
                    self._drop(one)
        self._end()
        yield from self._out(out)


class _PagedGroup(_Paged, _Group):
    pass


def _stateful(df: DataFrame, processor: _Changing, schema: str) -> DataFrame:
    return df.groupBy("row_group").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")


def _text(names: list[str], kinds: dict[str, T.DataType]) -> str:
    return ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in names)


def _key_schema(keys: list[str], kinds: dict[str, T.DataType]) -> str:
    return ", ".join(f"key{i} {kinds[c].simpleString()}" for i, c in enumerate(keys))


def group_changes(stream: DataFrame, keys: list[str], aggregates: dict[str, tuple[str, str]], op: str | None = None, update_before: bool = True, by_key: bool = False, groups: int = GROUPS) -> DataFrame:
    """The change log of a GROUP BY: op, keys, aggregates.

    aggregates: name to (one of FUNCTIONS, column, or `*` for count).  op names
    the column of stream's own ops; without it all rows are new.  A group whose
    rows have all been taken back is gone (-D).  update_before: whether updates
    have their first half.  Nulls are left out; sums are exact, of doubles too.
    by_key: each key's state has a row of its own, which Spark's state reader
    can show, at a call for each read and write.  groups: over how many groups
    keys are dealt, and so over how many tasks at most.  Both belong to the
    state: a checkpoint goes on with the same ones only.
    """
    kinds = {f.name: f.dataType for f in stream.schema}
    out: dict[str, T.DataType] = {}
    for name, (function, column) in aggregates.items():
        if function not in FUNCTIONS or column not in kinds and (function, column) != ("count", "*"):
            raise ValueError(f"no aggregate {function}({column}) for {name}")
        if function in ("sum", "avg") and not isinstance(kinds[column], (*WHOLE, T.FloatType, T.DoubleType)):
            raise ValueError(f"{column} can't be added up")
        out[name] = T.LongType() if function in ("count", "count_distinct") else T.DoubleType() if function == "avg" or function == "sum" and not isinstance(kinds[column], WHOLE) else T.LongType() if function == "sum" else kinds[column]
    values = sorted({c for _, c in aggregates.values() if c != "*"})
    rows = _by_group(stream, keys, values, groups, F.col(op) if op else None)
    processor = (_Group if by_key else _PagedGroup)(keys, _key_schema(keys, kinds), aggregates, {c: kinds[c] for c in values}, out, update_before, op is not None)
    return _stateful(rows, processor, f"op string, {_text(keys, kinds)}, {_text(list(out), out)}")


class _Latest(_Changing):
    def __init__(self, keys: list[str], key_schema: str, columns: list[str], order: list[str], schema: str, update_before: bool):
        self.keys, self.key_schema, self.columns, self.schema, self.update_before = keys, key_schema, columns, schema, update_before
        self.order = [columns.index(c) for c in order]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._init_rows(handle, self.key_schema, self.schema)

    def _rank(self, row: tuple) -> tuple:
        return tuple(_order(row[i]) for i in self.order)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        by_key, columns, _ = self._rows(rows, len(self.columns))
        new = list(zip(*columns))
        out: list[tuple] = []
        self._begin()
        for one, at in by_key.items():
            held = self._held(one)
            last = best = None if held is None else tuple(held)
            for i in at:
                if best is None or self._rank(new[i]) >= self._rank(best):
                    best = new[i]
            if change := self._change(one, last, best):
                self._keep(one, best)
                out += change
        self._end()
        yield from self._out(out)


class _PagedLatest(_Paged, _Latest):
    pass


def latest_changes(stream: DataFrame, keys: list[str], order: list[str], update_before: bool = True, by_key: bool = False, groups: int = GROUPS) -> DataFrame:
    """The change log of the latest row of each key: op, keys, the other columns.

    order: columns by which rows are compared, the last wins; rows that are
    behind the one held change nothing.  by_key, groups: as for group_changes.
    """
    kinds = {f.name: f.dataType for f in stream.schema}
    columns = [c for c in stream.columns if c not in keys]
    if missing := set(order) - set(columns):
        raise ValueError(f"no such columns: {sorted(missing)}")
    processor = (_Latest if by_key else _PagedLatest)(keys, _key_schema(keys, kinds), columns, order, _text(columns, kinds), update_before)
    return _stateful(_by_group(stream, keys, columns, groups), processor, f"op string, {_text(keys, kinds)}, {_text(columns, kinds)}")


def replayed(log: DataFrame, op: str = "op") -> DataFrame:
    """The table that a whole change log with both halves of updates leads to: each row as often as it was added and not taken back."""
    columns = [c for c in log.columns if c != op]
    sign = F.when(F.col(op).isin("+I", "+U"), 1).otherwise(-1)
    left = log.groupBy(*columns).agg(F.sum(sign).alias("_n")).where("_n > 0")
    return left.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_i")).drop("_i")
