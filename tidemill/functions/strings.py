"""String functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.multiset import ms_elements


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nvl(a: Column | str, b: Column | str) -> Column:
    """a, or b where a is null."""
    return F.coalesce(_col(a), _col(b))


def substring_index(text: Column | str, delimiter: str, count: int) -> Column:
    """What comes before the count-th delimiter (from the right if negative); '' for count 0 or an empty delimiter."""
    if count == 0 or delimiter == "":
        return F.when(_col(text).isNotNull(), F.lit(""))
    return F.substring_index(_col(text), delimiter, count)


def concat_ws(separator: str, *parts: Column | str, multisets: tuple[str, ...] = ()) -> Column:
    """Join strings, arrays and (named) multiset columns; nulls are left out, a multiset's element comes as often as it counts."""
    flat = [ms_elements(p) if isinstance(p, str) and p in multisets else _col(p) for p in parts]
    return F.concat_ws(separator, *flat)


def split(text: Column | str, pattern: str) -> Column:
    """Split at a regular expression; trailing empty parts stay."""
    return F.split(_col(text), pattern, -1)


def _decode(url: Column, encoding: str) -> Column:
    if encoding.lower().replace("-", "") == "utf8":
        return F.coalesce(F.try_url_decode(url), url)
    decoded = F.call_function("try_reflect", F.lit("java.net.URLDecoder"), F.lit("decode"), url, F.lit(encoding))
    return F.coalesce(decoded, url)


def url_decode(url: Column | str, encoding: str = "UTF-8") -> Column:
    """The decoded text; the input as it is where it can't be decoded."""
    return _decode(_col(url), encoding)


def url_decode_times(url: Column | str, times: int, encoding: str = "UTF-8") -> Column:
    """Decode a number of times over; the last value that could be had stays."""
    if times < 0:
        raise ValueError("times must not be negative")
    return reduce(lambda c, _: _decode(c, encoding), range(times), _col(url))


def regexp_extract(text: Column | str, pattern: str, group: int = 1) -> Column:
    """A group of the first match; '' without a match or if the group took no part."""
    return F.regexp_extract(_col(text), pattern, group)
