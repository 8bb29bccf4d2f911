"""Schemas written as text."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: Type names that Spark spells otherwise.
NAMES = {"row": "struct", "multiset": "multiset", "varchar": "string", "timestamp_ltz": "timestamp", "bytes": "binary", "integer": "int"}


def to_spark(text: str) -> str:
    """A type in Spark's spelling: row<a t> becomes struct<a: t>, multiset<t> a map from t to int."""
    text = re.sub(r"\b(char|varchar)\s*\(\s*\d+\s*\)", "string", text, flags=re.I)
    text = re.sub(r"\btimestamp_ltz\s*(\(\s*\d\s*\))?", "timestamp", re.sub(r"\btimestamp\s*\(\s*\d\s*\)", "timestamp_ntz", text, flags=re.I), flags=re.I)
    text = re.sub(r"\brow\s*<", "struct<", text, flags=re.I)
    text = re.sub(r"\bvarchar\b", "string", text, flags=re.I)
    text = re.sub(r"\bbytes\b", "binary", text, flags=re.I)
    while m := re.search(r"\bmultiset\s*<", text, flags=re.I):
        depth, end = 1, m.end()
        while depth and end < len(text):
            depth += {"<": 1, ">": -1}.get(text[end], 0)
            end += 1
        text = f"{text[: m.start()]}map<{text[m.end() : end - 1]}, int>{text[end:]}"
    return text


def parse_type(text: str) -> T.DataType:
    """A type, or the columns of a table (name type, ...), as Spark types."""
    return T.DataType.fromDDL(to_spark(text))


def parse_schema(text: str) -> T.StructType:
    """The columns of a table: 'a int, b row<c string>', with or without row<> around."""
    kind = parse_type(text)
    return kind if isinstance(kind, T.StructType) else T.StructType([T.StructField("value", kind)])


def to_text(schema: T.StructType) -> str:
    """The columns of a schema as text."""
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
