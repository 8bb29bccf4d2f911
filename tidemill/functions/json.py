"""JSON functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.sources.ddl import parse_type


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def get_json_object(json: Column | str, path: str) -> Column:
    """What stands at a path ($, .key, ['key'], [n], [*]); null for malformed JSON and JSON null."""
    if not re.match(r"\$", path):
        raise ValueError("a path begins with $")
    return F.get_json_object(_col(json), path)


def json_tuple(json: Column | str, *keys: str) -> Column:
    """A row with the top-level values of the keys, c0, c1, ...; nulls for malformed or null JSON."""
    if not keys or len(set(keys)) < len(keys):
        raise ValueError("keys must be given and differ")
    return F.json_tuple(_col(json), *keys)


def to_json(value: Column | str) -> Column:
    """JSON of a struct, array or map; null fields of structs are left out, null elements of arrays stay."""
    return F.to_json(_col(value))


def from_json(json: Column | str, schema: str | T.DataType, strict: bool = False, lenient_numbers: bool = True) -> Column:
    """A struct, array or map from JSON.

    schema may be written row<...> or struct<...>.  Malformed JSON gives null,
    or an error if strict.  With lenient_numbers, top-level numeric fields of a
    struct are also read from strings of digits.
    """
    kind = parse_type(schema) if isinstance(schema, str) else schema
    mode = {"mode": "FAILFAST" if strict else "PERMISSIVE"}
    numeric = isinstance(kind, T.StructType) and any(isinstance(f.dataType, T.NumericType) for f in kind.fields)
    if not (lenient_numbers and numeric):
        return F.from_json(_col(json), kind, mode)
    loose = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.NumericType) else f.dataType) for f in kind.fields])
    raw = F.from_json(_col(json), loose, mode)
    fields = [(raw[f.name].try_cast(f.dataType) if isinstance(f.dataType, T.NumericType) else raw[f.name]).alias(f.name) for f in kind.fields]
    return F.when(raw.isNotNull(), F.struct(*fields))
