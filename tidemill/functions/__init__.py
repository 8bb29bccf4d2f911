"""Column functions: strings, dates, collections, JSON, multisets and table functions.

All of them build Columns from Spark's own functions, so that they stay in
generated code.  Arguments that must be known when the query is planned are
plain Python values and are checked there.
"""

from tidemill.functions.collections import array_contains, array_distinct, array_max, array_min, named_struct, size, slice_array, sort_array
from tidemill.functions.dates import add_days, day_of_week, days_since_epoch, extract_unix_timestamp, floor_to, second_of_day
from tidemill.functions.json import from_json, get_json_object, json_tuple, to_json
from tidemill.functions.multiset import ms_distinct, ms_elements, ms_explode, ms_from_array, ms_posexplode, ms_size
from tidemill.functions.reflection import java_method
from tidemill.functions.registry import register_all
from tidemill.functions.strings import concat_ws, nvl, regexp_extract, split, substring_index, url_decode, url_decode_times
from tidemill.functions.tables import explode, posexplode

__all__ = [
    "add_days", "array_contains", "array_distinct", "array_max", "array_min", "concat_ws", "day_of_week", "days_since_epoch", "explode", "extract_unix_timestamp", "floor_to",
    "from_json", "get_json_object", "java_method", "json_tuple", "ms_distinct", "ms_elements", "ms_explode", "ms_from_array", "ms_posexplode", "ms_size", "named_struct", "nvl",
    "posexplode", "regexp_extract", "register_all", "second_of_day", "size", "slice_array", "sort_array", "split", "substring_index", "to_json", "url_decode", "url_decode_times",
]
