"""Aggregates with map, multiset and list results.

All count or sum per (group, value) first, so that only small partial results
are shuffled, and build the map of a group from its distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _map_of(df: DataFrame, keys: list[str], value: str, amount: Column, kind: str, out: str, keep: Column) -> DataFrame:
    """One row per group with a map from value to amount; groups without pairs get an empty map."""
    pairs = df.groupBy(*keys, value).agg(F.sum(F.when(keep, amount)).cast(kind).alias("_n"), F.count(F.when(keep, 1)).alias("_k"))
    entry = F.when(F.col("_k") > 0, F.struct(F.col(value).alias("key"), F.col("_n").alias("value")))
    return pairs.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(out))


def value_count(df: DataFrame, keys: list[str], value: str, out: str = "counts", wide: bool = False) -> DataFrame:
    """For each group a map from value to its number of rows (int, or long if wide); nulls are left out."""
    return _map_of(df, keys, value, F.lit(1), "long" if wide else "int", out, F.col(value).isNotNull())


def value_sum(df: DataFrame, keys: list[str], key: str, value: str, out: str = "sums") -> DataFrame:
    """For each group a map from key to the sum of value: long for whole numbers, else double; pairs with a null are left out."""
    kind = "long" if dict(df.dtypes)[value] in ("tinyint", "smallint", "int", "bigint") else "double"
    return _map_of(df, keys, key, F.col(value).cast(kind), kind, out, F.col(key).isNotNull() & F.col(value).isNotNull())


def collect_multiset(df: DataFrame, keys: list[str], value: str, out: str = "elements") -> DataFrame:
    """For each group the multiset of values: a map from element to count."""
    return value_count(df, keys, value, out)


def listagg(value: Column | str, separator: str = ",", order: Column | str | None = None) -> Column:
    """The values joined by a separator (a comma unless given), in order of themselves or of another column; nulls are left out."""
    c = F.col(value) if isinstance(value, str) else value
    if order is None:
        return F.array_join(F.sort_array(F.collect_list(c)), separator)
    o = F.col(order) if isinstance(order, str) else order
    pairs = F.filter(F.sort_array(F.collect_list(F.struct(o.alias("o"), c.alias("v")))), lambda p: p["v"].isNotNull())
    return F.array_join(F.transform(pairs, lambda p: p["v"].cast("string")), separator)


def my_avg(value: Column | str) -> Column:
    """Sum over count of the values that aren't null; null if there are none."""
    return F.avg(value)


def count_distinct_over(value: Column | str, window) -> Column:
    """Distinct values in a window frame."""
    return F.size(F.collect_set(value).over(window))
