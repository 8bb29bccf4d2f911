"""Table functions: rows from arrays, maps and multisets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def explode(df: DataFrame, c: str, outer: bool = False, names: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each element (col) or entry (key, value); none for null or empty, or one with nulls if outer."""
    is_map = isinstance(df.schema[c].dataType, T.MapType)
    f = F.explode_outer if outer else F.explode
    return df.select("*", f(c).alias(*(names or (("key", "value") if is_map else ("col",)))))


def posexplode(df: DataFrame, c: str, outer: bool = False, names: tuple[str, ...] | None = None) -> DataFrame:
    """The same, with the place from 0 as pos."""
    is_map = isinstance(df.schema[c].dataType, T.MapType)
    f = F.posexplode_outer if outer else F.posexplode
    return df.select("*", f(c).alias("pos", *(names or (("key", "value") if is_map else ("col",)))))
