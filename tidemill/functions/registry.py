"""SQL names for the functions that differ from Spark's own."""

from __future__ import annotations

import warnings

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import ArrowUDFType, arrow_udf, udtf

from tidemill.functions.table_functions import TABLE_FUNCTIONS

#: Name, parameters, result and body of each function; the bodies are inlined by the planner.
SQL_FUNCTIONS = [
    ("url_decode_or_same", "url STRING", "STRING", "coalesce(try_url_decode(url), url)"),
    ("url_decode_twice", "url STRING", "STRING", "coalesce(try_url_decode(coalesce(try_url_decode(url), url)), coalesce(try_url_decode(url), url))"),
    ("extract_unix_timestamp", "ts TIMESTAMP", "BIGINT", "unix_seconds(ts)"),
    ("array_size_or_minus1", "a ARRAY<STRING>", "INT", "coalesce(size(a), -1)"),
    ("map_size_or_minus1", "m MAP<STRING, INT>", "INT", "coalesce(size(m), -1)"),
    ("add_days", "day STRING, days INT", "DATE", "date_add(try_cast(day AS DATE), days)"),
    ("floor_minutes", "ts TIMESTAMP, minutes INT", "TIMESTAMP", "timestamp_seconds(unix_seconds(ts) - pmod(unix_seconds(ts), minutes * 60))"),
    ("multiset_elements", "m MAP<STRING, INT>", "ARRAY<STRING>", "flatten(transform(map_entries(m), e -> array_repeat(e.key, e.value)))"),
    ("days_since_epoch", "ts TIMESTAMP", "INT", "datediff(cast(ts AS DATE), DATE'1970-01-01')"),
]
#: Functions that Spark has under the same name and with the same meaning.
BUILT_IN = ["nvl", "substring_index", "concat_ws", "split", "regexp_extract", "get_json_object", "to_json", "from_json", "named_struct", "slice", "array_distinct", "array_contains", "array_max", "array_min", "sort_array", "explode", "posexplode", "json_tuple"]


#: Types of the keys of value maps in GROUP BY, by the ending of the function's name; the bare name takes strings.
KEY_TYPES = {"": pa.string(), "_int": pa.int32(), "_bigint": pa.int64(), "_double": pa.float64(), "_boolean": pa.bool_(), "_date": pa.date32(), "_timestamp": pa.timestamp("us", tz="UTC")}
_SQL_TYPES = {"": "string", "_int": "int", "_bigint": "bigint", "_double": "double", "_boolean": "boolean", "_date": "date", "_timestamp": "timestamp"}


def _checked(values: pa.Array, kind: pa.DataType, name: str) -> pa.Array:
    """The values, if their type is the function's; another type is an error and never cast."""
    if pa.types.is_null(values.type):
        return values.cast(kind)
    if pa.types.is_timestamp(kind) and pa.types.is_timestamp(values.type) and values.type.tz is not None:
        return values.cast(kind)
    if values.type != kind:
        raise TypeError(f"{name} takes {kind}, not {values.type}; other types have functions of their own, and the table functions take any")
    return pc.add(values, 0.0) if pa.types.is_floating(kind) else values  # no negative zero


def _counting(name: str, kind: pa.DataType, out: pa.DataType):
    def value_count(values: pa.Array, *wide: pa.Array) -> pa.Scalar:
        found = _checked(values, kind, name).drop_null().value_counts()
        return pa.scalar(list(zip(found.field("values").to_pylist(), found.field("counts").to_pylist())), pa.map_(kind, out))

    return value_count


def _adding(name: str, kind: pa.DataType, out: pa.DataType):
    def value_sum(keys: pa.Array, values: pa.Array) -> pa.Scalar:
        keys = _checked(keys, kind, name)
        if not pa.types.is_null(values.type) and (pa.types.is_integer(values.type), pa.types.is_floating(values.type)) != (pa.types.is_integer(out), pa.types.is_floating(out)):
            raise TypeError(f"{name} adds up {out}, not {values.type}")
        # Whole numbers are added up in decimals, as 64 bits would wrap around.
        pairs = pa.table({"k": keys, "v": values.cast(pa.decimal128(38, 0) if pa.types.is_integer(out) else out)}).drop_null()
        found = pairs.group_by("k").aggregate([("v", "sum")])
        sums = found.column("v_sum").to_pylist()
        if pa.types.is_integer(out):
            sums = [int(s) for s in sums]
            if any(not -(2**63) <= s < 2**63 for s in sums):
                raise OverflowError("a sum doesn't fit in 64 bits")
        return pa.scalar(list(zip(found.column("k").to_pylist(), sums)), pa.map_(kind, out))

    return value_sum


def aggregates() -> dict[str, tuple]:
    """Aggregates for GROUP BY: name to (function, type of the result).

    value_count[_<key type>] gives map<key, int>, value_count_wide[...] map<key,
    bigint>; a second argument is taken and ignored.  value_sum[_<key type>]
    adds up whole numbers to bigint, value_sum_of_doubles[...] doubles.  A
    group's values go to one task; the table functions take partial counts.
    """
    out = {}
    for ending, kind in KEY_TYPES.items():
        sql = _SQL_TYPES[ending]
        for name, amount, text, make in (("value_count", pa.int32(), "int", _counting), ("value_count_wide", pa.int64(), "bigint", _counting), ("value_sum", pa.int64(), "bigint", _adding), ("value_sum_of_doubles", pa.float64(), "double", _adding)):
            out[name + ending] = (make(name + ending, kind, amount), f"map<{sql},{text}>")
    return out


def register_all(spark: SparkSession) -> list[str]:
    """Make the functions known to SQL in this session; gives all names that can be used."""
    for name, parameters, result, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # the kind can't be told from type hints where there may be more arguments
        for name, (function, result) in aggregates().items():
            spark.udf.register(name, arrow_udf(function, result, ArrowUDFType.GROUPED_AGG))
    for name, one in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(one))
    return [*(name for name, *_ in SQL_FUNCTIONS), *aggregates(), *TABLE_FUNCTIONS, *BUILT_IN]
