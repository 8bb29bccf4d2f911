"""Calls of static Java methods, from a list of allowed classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classes without side effects.
ALLOWED = {"java.lang.Math", "java.lang.Integer", "java.lang.Long", "java.lang.String", "java.net.URLDecoder", "java.net.URLEncoder", "java.util.UUID"}


def java_method(class_name: str, method: str, *args: Column, allowed: set[str] | None = None) -> Column:
    """The result of a static method as a string; null if it throws."""
    if class_name not in (ALLOWED if allowed is None else allowed):
        raise PermissionError(f"{class_name} is not among the allowed classes")
    return F.call_function("try_reflect", F.lit(class_name), F.lit(method), *args)
