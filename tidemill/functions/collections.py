"""Functions of arrays, maps and structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def size(c: Column | str) -> Column:
    """Elements of an array or entries of a map (distinct elements of a multiset); -1 for null."""
    return F.coalesce(F.size(_col(c)), F.lit(-1))


def slice_array(c: Column | str, start: int, length: int) -> Column:
    """length elements from the start-th (from 1, or from the end if negative); [] out of range."""
    if start == 0 or length < 0:
        raise ValueError("start must not be 0, length must not be negative")
    return F.slice(_col(c), start, length)


def array_distinct(c: Column | str) -> Column:
    """Distinct elements, in order of their first occurrence."""
    return F.array_distinct(_col(c))


def array_contains(c: Column | str, value) -> Column:
    """True if the value is in the array; null if it isn't and the array has nulls, or if either is null."""
    return F.array_contains(_col(c), value)


def array_max(c: Column | str) -> Column:
    return F.array_max(_col(c))


def array_min(c: Column | str) -> Column:
    return F.array_min(_col(c))


def sort_array(c: Column | str, ascending: bool = True) -> Column:
    """Sorted elements; nulls come first if ascending, else last."""
    return F.sort_array(_col(c), ascending)


def named_struct(**fields: Column) -> Column:
    """A struct of named values."""
    if not fields:
        raise ValueError("a struct needs a field")
    return F.struct(*[_col(v).alias(k) for k, v in fields.items()])
