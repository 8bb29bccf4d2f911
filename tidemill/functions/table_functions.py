"""SQL table functions whose result types follow from their arguments when a query is planned.

Each is a class with ``analyze``, which sees the argument table's schema and
the literals, and names the columns that the function needs, how its input is
partitioned and what it returns.  So keys and values keep their own types::

    SELECT * FROM value_count(TABLE(events), 'user_id', 'level')
    SELECT * FROM value_sum(TABLE(events), 'user_id', 'level', 'score')

Rows are shuffled by the keys as they come.  Counts or sums of equal values
may be taken before, natively and on both sides of the shuffle, and given as
a weight, which is the form for large or uneven groups::

    SELECT * FROM value_count(TABLE(SELECT user_id, level, count(*) AS n FROM events GROUP BY ALL), 'user_id', 'level', weight => 'n')
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn, SelectedColumn

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NAN = float("nan")
_MOST = 2**63


def literal(argument: AnalyzeArgument | None, name: str, default: Any = None) -> Any:
    """The constant that an argument is."""
    if argument is None:
        return default
    if argument.isTable or not argument.isConstantExpression or argument.value is None:
        raise ValueError(f"{name} has to be a constant")
    return argument.value


def field(table: AnalyzeArgument, name: str) -> T.StructField:
    """A column of the argument table, by a name in any case."""
    if not table.isTable:
        raise ValueError("the first argument has to be a table: TABLE(name) or TABLE(SELECT ...)")
    found = [f for f in table.dataType if f.name.lower() == name.strip().lower()]
    if not found:
        raise ValueError(f"the table has no column {name.strip()}, but {', '.join(table.dataType.names)}")
    return found[0]


def fields(table: AnalyzeArgument, names: str) -> list[T.StructField]:
    """Columns from a list of names with commas."""
    return [field(table, n) for n in names.split(",") if n.strip()]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _can_be_key(kind: T.DataType) -> bool:
    return all(_can_be_key(f.dataType) for f in kind) if isinstance(kind, T.StructType) else not isinstance(kind, (T.ArrayType, T.MapType, T.VariantType, T.NullType))


def same(value: Any) -> Any:
    """A key for which equal values in SQL are equal in Python: one NaN, no negative zero."""
    return (_NAN if math.isnan(value) else value + 0.0) if isinstance(value, float) else value


class _ValueMap:
    """A map for each group: keys of the group, the map's key, its amount, perhaps a weight; nulls are left out."""

    def __init__(self) -> None:
        self.group: tuple | None = None
        self.held: dict[Any, Any] = {}

    @staticmethod
    def _plan(table: AnalyzeArgument, keys: list[T.StructField], kept: list[T.StructField], out: str, kind: T.DataType) -> AnalyzeResult:
        if not keys:
            raise ValueError("no keys are named")
        if not _can_be_key(kept[0].dataType):
            raise ValueError(f"values of type {kept[0].dataType.simpleString()} can't be keys of a map")
        schema = T.StructType([*keys, T.StructField(out, T.MapType(kept[0].dataType, kind, False), False)])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(quoted(f.name)) for f in keys], select=[SelectedColumn(quoted(f.name)) for f in (*keys, *kept)])

    def _add(self, row: Any, keys: str, key: Any, amount: Any) -> None:
        if self.group is None:
            self.group = tuple(row[i] for i in range(len([n for n in keys.split(",") if n.strip()])))
        if key is not None and amount is not None:
            key = same(key)
            self.held[key] = self.held.get(key, 0) + amount

    def terminate(self) -> Iterator[tuple]:
        if self.group is not None:
            if any(isinstance(v, int) and not -_MOST <= v < _MOST for v in self.held.values()):
                raise OverflowError("a count or sum doesn't fit in 64 bits")
            yield (*self.group, self.held)


class ValueCount(_ValueMap):
    """value_count(TABLE t, keys, value [, wide => true] [, weight => column]): the keys, and counts, a map from value to its number of rows.

    keys: column names with commas.  Counts are INT, or BIGINT if wide or
    weighted.  Null values are left out; a group without others has an empty map.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, keys: AnalyzeArgument, value: AnalyzeArgument, wide: AnalyzeArgument | None = None, weight: AnalyzeArgument | None = None) -> AnalyzeResult:
        kept = [field(table, literal(value, "value"))]
        if weight is not None:
            kept.append(field(table, literal(weight, "weight")))
            if not isinstance(kept[1].dataType, WHOLE):
                raise ValueError("a weight has to be a whole number")
        kind = T.LongType() if weight is not None or literal(wide, "wide", False) else T.IntegerType()
        return _ValueMap._plan(table, fields(table, literal(keys, "keys")), kept, "counts", kind)

    def eval(self, row: Any, keys: str, value: str, wide: Any = None, weight: str | None = None) -> None:
        n = len([x for x in keys.split(",") if x.strip()])
        self._add(row, keys, row[n], row[n + 1] if weight is not None else 1)


class ValueSum(_ValueMap):
    """value_sum(TABLE t, keys, key, value): the keys, and sums, a map from key to the sum of value.

    Sums are BIGINT for whole numbers, else DOUBLE.  Pairs with a null are left out.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, keys: AnalyzeArgument, key: AnalyzeArgument, value: AnalyzeArgument) -> AnalyzeResult:
        kept = [field(table, literal(key, "key")), field(table, literal(value, "value"))]
        if not isinstance(kept[1].dataType, T.NumericType):
            raise ValueError(f"values of type {kept[1].dataType.simpleString()} can't be added up")
        kind = T.LongType() if isinstance(kept[1].dataType, WHOLE) else T.DoubleType()
        return _ValueMap._plan(table, fields(table, literal(keys, "keys")), kept, "sums", kind)

    def eval(self, row: Any, keys: str, key: str, value: str) -> None:
        n = len([x for x in keys.split(",") if x.strip()])
        amount = row[n + 1]
        self._add(row, keys, row[n], amount if amount is None or isinstance(amount, int) else float(amount))


class _Elements:
    """The table's columns, and the elements of a multiset (a map from element to count), an array, or a map's entries."""

    @staticmethod
    def _plan(table: AnalyzeArgument, column: AnalyzeArgument, place: bool) -> AnalyzeResult:
        kind = field(table, literal(column, "column")).dataType
        if isinstance(kind, T.MapType) and isinstance(kind.valueType, WHOLE):
            element = kind.keyType
        elif isinstance(kind, T.ArrayType):
            element = kind.elementType
        else:
            raise ValueError(f"{kind.simpleString()} is neither a multiset nor an array")
        extra = [T.StructField("pos", T.IntegerType(), False)] if place else []
        return AnalyzeResult(T.StructType([*table.dataType, *extra, T.StructField("col", element)]))

    @staticmethod
    def _of(row: Any, column: str) -> Iterator[Any]:
        held = next(v for n, v in row.asDict().items() if n.lower() == column.strip().lower())
        if isinstance(held, dict):
            for element, n in held.items():
                yield from (element for _ in range(n or 0))
        else:
            yield from held or ()


class MultisetExplode(_Elements):
    """multiset_explode(TABLE t, column): a row for each element, as often as it counts; none for null."""

    @staticmethod
    def analyze(table: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
        return _Elements._plan(table, column, False)

    def eval(self, row: Any, column: str) -> Iterator[tuple]:
        for x in self._of(row, column):
            yield (*row, x)


class MultisetPosexplode(_Elements):
    """multiset_posexplode(TABLE t, column): the same with a running number from 0."""

    @staticmethod
    def analyze(table: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
        return _Elements._plan(table, column, True)

    def eval(self, row: Any, column: str) -> Iterator[tuple]:
        for i, x in enumerate(self._of(row, column)):
            yield (*row, i, x)


#: How a JSON value becomes one of a simple type; what doesn't fit is null.
_READ = {
    "string": lambda v: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":")),
    "boolean": lambda v: {"true": True, "false": False}[v.strip().lower()] if isinstance(v, str) else v if isinstance(v, bool) else None,
    "float": float, "double": float,
    "tinyint": (8, int), "smallint": (16, int), "int": (32, int), "bigint": (64, int),
}


SIMPLE = {"string": T.StringType(), "boolean": T.BooleanType(), "float": T.FloatType(), "double": T.DoubleType(), "tinyint": T.ByteType(), "smallint": T.ShortType(), "int": T.IntegerType(), "bigint": T.LongType()}


def named_types(text: str) -> list[tuple[str, str]]:
    """Names and simple types from 'a INT, b STRING'.  Plans are analysed in a process without a session, which parses nothing itself."""
    found = [tuple(part.split()) for part in text.split(",")]
    if bad := [" ".join(f) for f in found if len(f) != 2 or f[1].lower() not in SIMPLE]:
        raise ValueError(f"not a name and a simple type: {', '.join(bad)}")
    return [(name, kind.lower()) for name, kind in found]


def read_as(value: Any, kind: str) -> Any:
    """A JSON value as a simple type; numbers may stand in strings; null if it doesn't fit."""
    if value is None:
        return None
    how = _READ[kind]
    try:
        if isinstance(how, tuple):
            whole = None if isinstance(value, bool) or isinstance(value, float) and value != int(value) else int(value)
            return whole if whole is not None and -(2 ** (how[0] - 1)) <= whole < 2 ** (how[0] - 1) else None
        return None if isinstance(value, bool) and kind in ("float", "double") else how(value)
    except (ValueError, TypeError, KeyError, OverflowError):
        return None


class JsonFields:
    """json_fields(TABLE t, column, fields): the table's columns, and the named fields of a JSON column with their types.

    fields: schema text such as 'k BIGINT, name STRING', a literal from which
    the result's columns follow.  What isn't JSON, or no object, gives nulls.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, column: AnalyzeArgument, fields: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(field(table, literal(column, "column")).dataType, T.StringType):
            raise ValueError("the column has to be text")
        wanted = named_types(literal(fields, "fields"))
        if both := {name.lower() for name, _ in wanted} & {n.lower() for n in table.dataType.names}:
            raise ValueError(f"the table has columns of these names already: {', '.join(sorted(both))}")
        return AnalyzeResult(T.StructType([*table.dataType, *(T.StructField(name, SIMPLE[kind]) for name, kind in wanted)]))

    def __init__(self) -> None:
        self.wanted: list[tuple[str, str]] | None = None

    def eval(self, row: Any, column: str, fields: str) -> Iterator[tuple]:
        if self.wanted is None:
            self.wanted = named_types(fields)
            self.place = [n.lower() for n in row.__fields__].index(column.strip().lower())
        try:
            held = json.loads(row[self.place] or "null")
        except ValueError:
            held = None
        held = held if isinstance(held, dict) else {}
        yield (*row, *(read_as(held.get(name), kind) for name, kind in self.wanted))


#: SQL names of the table functions.
TABLE_FUNCTIONS = {"value_count": ValueCount, "value_sum": ValueSum, "multiset_explode": MultisetExplode, "multiset_posexplode": MultisetPosexplode, "json_fields": JsonFields}
