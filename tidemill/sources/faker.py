"""Generated rows: columns drawn from small expressions, the same for a seed in every run.

An expression is ``#{generator 'argument', ...}`` or text with such parts.
Every value depends on (seed, row number, column) alone, by hashes in
generated code, so rows can be made in any number of partitions.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.sources.ddl import parse_schema

#: Words to draw from; any list does, as no result depends on them.
NAMES = {
    "superhero.name": ["Amber Falcon", "Iron Tide", "Silver Comet", "Night Heron", "Copper Bolt", "Glass Tiger", "Storm Petrel", "Red Lantern"],
    "superhero.power": ["flight", "speed", "strength", "invisibility", "telepathy", "healing", "time travel"],
    "harry_potter.spell": ["Lumos", "Nox", "Accio", "Alohomora", "Riddikulus", "Reparo", "Silencio"],
    "name.name": ["Ada Park", "Bo Lind", "Cleo Marsh", "Dana Field", "Eli Stone", "Flo Rivers"],
    "name.first_name": ["Ada", "Bo", "Cleo", "Dana", "Eli", "Flo"],
    "name.last_name": ["Park", "Lind", "Marsh", "Field", "Stone", "Rivers"],
}
#: Seconds in the units of date expressions.
UNITS = {"SECONDS": 1, "MINUTES": 60, "HOURS": 3600, "DAYS": 86400}


def unit(seed: int, label: str, row: Column) -> Column:
    """A number in [0, 1) for each row."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(label), row), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _pick(choices: list[str], u: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, choices)), (F.floor(u * len(choices)) + 1).cast("int"))


def _arguments(text: str) -> list[str]:
    return [a.replace("''", "'") for a in re.findall(r"'((?:[^']|'')*)'", text)]


def _regexify(pattern: str, seed: int, label: str, row: Column) -> Column:
    """Text for patterns of literals, (a|b), [abc] and [a-z], each with an optional {n}."""
    parts, i = [], 0
    for n, m in enumerate(re.finditer(r"\(([^()]*)\)(?:\{(\d+)\})?|\[([^\]]*)\](?:\{(\d+)\})?|\\?([^()\[\]{}])", pattern)):
        if m.start() != i:
            raise ValueError(f"not understood: {pattern[i:]!r}")
        i = m.end()
        if m[1] is not None:
            choices, times = [re.sub(r"\\(.)", r"\1", c) for c in m[1].split("|")], int(m[2] or 1)
        elif m[3] is not None:
            spread = re.sub(r"(.)-(.)", lambda r: "".join(map(chr, range(ord(r[1]), ord(r[2]) + 1))), m[3])
            choices, times = list(spread), int(m[4] or 1)
        else:
            choices, times = [m[5]], 1
        parts += [_pick(choices, unit(seed, f"{label}/{n}/{t}", row)) if len(choices) > 1 else F.lit(choices[0]) for t in range(times)]
    if i != len(pattern):
        raise ValueError(f"not understood: {pattern[i:]!r}")
    return F.concat(*parts) if parts else F.lit("")


def draw(expression: str, seed: int, label: str, row: Column, now: Column) -> Column:
    """The value of an expression as a string or a timestamp."""
    pieces, at = [], 0
    for k, m in enumerate(re.finditer(r"#\{\s*([\w.]+)((?:[^{}']|'(?:[^']|'')*')*)\}", expression)):
        if m.start() > at:
            pieces.append(F.lit(expression[at : m.start()]))
        at = m.end()
        name, args, u = m[1].lower(), _arguments(m[2]), unit(seed, f"{label}#{k}", row)
        if name == "regexify":
            pieces.append(_regexify(args[0], seed, f"{label}#{k}", row))
        elif name == "number.numberbetween":
            lo, hi = map(int, args)
            pieces.append((F.lit(lo).cast("long") + F.floor(u * (hi - lo)).cast("long")) if hi > lo else F.lit(lo).cast("long"))
        elif name == "number.randomdouble":
            digits, lo, hi = map(float, args)
            pieces.append(F.round(u * (hi - lo) + lo, int(digits)))
        elif name == "date.past":
            most, least, scale = (args[0], "0", args[1]) if len(args) == 2 else args[:3]
            back = (u * (float(most) - float(least)) + float(least)) * UNITS[scale.upper()]
            pieces.append(F.timestamp_micros((F.unix_micros(now) - back * 1e6).cast("long")))
        elif name in NAMES:
            pieces.append(_pick(NAMES[name], u))
        else:
            raise ValueError(f"no generator is called {m[1]!r}")
    if at < len(expression):
        pieces.append(F.lit(expression[at:]))
    return pieces[0] if len(pieces) == 1 else F.concat(*[p.cast("string") for p in pieces])


def _value(kind: T.DataType, options: dict[str, str], path: str, seed: int, label: str, row: Column, now: Column) -> Column:
    length = int(options.get(f"fields.{path}.length", "1"))
    expression = options.get(f"fields.{path}.expression")

    def several(one) -> list[Column]:
        return [one(f"{label}[{i}]") for i in range(length)]

    if isinstance(kind, T.StructType):
        out = F.struct(*[_value(f.dataType, options, f"{path}.{f.name}", seed, f"{label}.{f.name}", row, now).alias(f.name) for f in kind.fields])
    elif isinstance(kind, T.ArrayType):
        out = F.array(*several(lambda at: _value(kind.elementType, options, path, seed, at, row, now) if expression or isinstance(kind.elementType, T.StructType) else F.lit(None)))
    elif isinstance(kind, T.MapType) and expression:  # a multiset: drawn elements, counted
        elements = F.array(*several(lambda at: draw(expression, seed, at, row, now).try_cast(kind.keyType)))
        entry = lambda x: F.struct(x.alias("key"), F.size(F.filter(elements, lambda y: y == x)).alias("value"))
        out = F.map_from_entries(F.transform(F.array_distinct(elements), entry))
    elif isinstance(kind, T.MapType):
        keys = F.array(*several(lambda at: draw(options[f"fields.{path}.key.expression"], seed, f"{at}.key", row, now).try_cast(kind.keyType)))
        pairs = F.arrays_zip(keys.alias("key"), F.array(*several(lambda at: draw(options[f"fields.{path}.value.expression"], seed, f"{at}.value", row, now).try_cast(kind.valueType))).alias("value"))
        first = F.transform(F.array_distinct(keys), lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1))
        out = F.map_from_entries(F.transform(first, lambda p: F.struct(p["key"], p["value"])))
    elif expression is None:
        raise ValueError(f"fields.{path}.expression is missing")
    else:
        out = draw(expression, seed, label, row, now)
        out = out.cast(kind) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.StringType)) else out.try_cast(kind)
    rate = float(options.get(f"fields.{path}.null-rate", "0"))
    if not 0 <= rate <= 1:
        raise ValueError(f"fields.{path}.null-rate must be in 0..1")
    return F.when(unit(seed, f"{label}?", row) >= rate, out) if rate and not label.endswith("]") else out


def fake_columns(rows: DataFrame, number: str, schema: T.StructType | str, options: dict[str, str], seed: int = 0, now: Column | None = None, keep: list[str] = ()) -> DataFrame:
    """Replace numbered rows by drawn ones; columns in keep are echoed as they are (a lookup's keys)."""
    kind = parse_schema(schema) if isinstance(schema, str) else schema
    now = F.current_timestamp() if now is None else now
    columns = [F.col(f.name) if f.name in keep else _value(f.dataType, options, f.name, seed, f.name, F.col(number), now).alias(f.name) for f in kind.fields]
    return rows.select(*columns)


def fake(spark: SparkSession, schema: T.StructType | str, options: dict[str, str], seed: int = 0, now: Column | None = None) -> DataFrame:
    """A bounded table of number-of-rows rows."""
    rows = int(options.get("number-of-rows", "-1"))
    if rows < 0:
        raise ValueError("number-of-rows must be given for a batch; use fake_stream for an unbounded table")
    return fake_columns(spark.range(rows), "id", schema, options, seed, now)


def fake_stream(spark: SparkSession, schema: T.StructType | str, options: dict[str, str], seed: int = 0) -> DataFrame:
    """An unbounded table of rows-per-second (10000) rows a second, dealt over the partitions by the rate source."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", options.get("rows-per-second", "10000")).load()
    limit = int(options.get("number-of-rows", "-1"))
    rate = rate if limit < 0 else rate.where(F.col("value") < limit)
    return fake_columns(rate, "value", schema, options, seed, F.col("timestamp"))


def fake_lookup(left: DataFrame, keys: dict[str, str], schema: T.StructType | str, options: dict[str, str], seed: int = 0) -> DataFrame:
    """Join each row with one drawn row of its keys: the keys are echoed, the rest depends on them alone."""
    kind = parse_schema(schema) if isinstance(schema, str) else schema
    row = F.xxhash64(*[F.col(k) for k in keys])
    now = F.current_timestamp()
    drawn = [_value(f.dataType, options, f.name, seed, f.name, row, now).alias(f.name) for f in kind.fields if f.name not in keys.values()]
    return left.select("*", *[F.col(a).alias(b) for a, b in keys.items() if b not in left.columns], *drawn)


def datagen(spark: SparkSession, schema: T.StructType | str, options: dict[str, str], rows: int, seed: int = 0) -> DataFrame:
    """Random columns between fields.<c>.min and max, or sequences from start to end, which also end the table."""
    kind = parse_schema(schema) if isinstance(schema, str) else schema
    ends = [int(options[f"fields.{f.name}.end"]) - int(options[f"fields.{f.name}.start"]) + 1 for f in kind.fields if options.get(f"fields.{f.name}.kind") == "sequence"]
    columns = []
    for f in kind.fields:
        if options.get(f"fields.{f.name}.kind") == "sequence":
            columns.append((F.col("id") + int(options[f"fields.{f.name}.start"])).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            length = int(options.get(f"fields.{f.name}.length", "100"))
            columns.append(F.substring(F.repeat(F.sha2(F.concat(F.lit(f"{seed}/{f.name}/"), F.col("id").cast("string")), 256), -(-length // 64)), 1, length).alias(f.name))
        else:
            lo, hi = float(options.get(f"fields.{f.name}.min", "0")), float(options.get(f"fields.{f.name}.max", "2147483647"))
            u = unit(seed, f.name, F.col("id"))
            whole = isinstance(f.dataType, T.IntegralType)
            columns.append(((F.floor(u * (hi - lo + 1)) if whole else u * (hi - lo)) + F.lit(int(lo) if whole else lo)).cast(f.dataType).alias(f.name))
    return spark.range(min([rows, *ends])).select(*columns)


def click_log(rows: DataFrame, number: str, start: Column, per_tick: int = 5, pages: int = 5, late: bool = False, seed: int = 0) -> DataFrame:
    """A click log from numbered rows: so many clicks every 500 ms of event time; with late, each click of every fifth tick again 10 s earlier."""
    n = F.col(number)
    tick = F.floor(n / per_tick)
    base = rows.select(n.alias("_n"), tick.alias("_tick"), F.floor(unit(seed, "page", n) * pages).cast("string").alias("page_id"), F.floor(unit(seed, "user", n) * 100).cast("string").alias("user_id"))
    shifts = F.when(F.lit(late) & (F.col("_tick") % 5 == 0), F.array(F.lit(0), F.lit(-10_000))).otherwise(F.array(F.lit(0)))
    timed = base.withColumn("_shift", F.explode(shifts))
    millis = F.unix_millis(start) + F.col("_tick") * 500 + F.col("_shift")
    return timed.select("page_id", "user_id", F.timestamp_millis(millis).alias("event_time"), F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd HH:mm:ss").alias("event_time_str"), F.lit(1).alias("visit_cnt"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """All rows of several tables, by column name."""
    return reduce(DataFrame.unionByName, parts)
