"""Multisets, kept as maps from element to count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ms_from_array(c: Column | str) -> Column:
    """The multiset of an array's elements other than null."""
    array = F.filter(_col(c), lambda x: x.isNotNull())
    entry = lambda x: F.struct(x.alias("key"), F.size(F.filter(array, lambda y: y == x)).alias("value"))
    return F.map_from_entries(F.transform(F.array_distinct(array), entry))


def ms_elements(c: Column | str) -> Column:
    """An array with every element as often as it counts."""
    return F.flatten(F.transform(F.map_entries(_col(c)), lambda e: F.array_repeat(e["key"], e["value"].cast("int"))))


def ms_size(c: Column | str) -> Column:
    """Distinct elements; -1 for null."""
    return F.coalesce(F.size(_col(c)), F.lit(-1))


def ms_distinct(c: Column | str) -> Column:
    return F.map_keys(_col(c))


def ms_explode(df: DataFrame, c: str, alias: str = "col") -> DataFrame:
    """A row for every element, as often as it counts; none for null."""
    return df.select("*", F.explode(ms_elements(c)).alias(alias))


def ms_posexplode(df: DataFrame, c: str, alias: str = "col") -> DataFrame:
    """The same with a running number from 0."""
    return df.select("*", F.posexplode(ms_elements(c)).alias("pos", alias))
