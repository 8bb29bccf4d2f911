"""Decoding and encoding of rows: JSON in three strictnesses, CSV, raw, bytes and protobuf."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemill.sources.ddl import parse_schema


def _kind(schema: T.StructType | str) -> T.StructType:
    return parse_schema(schema) if isinstance(schema, str) else schema


def _number_or_text(raw: Column, kind: T.DataType) -> Column:
    """Numbers also from strings; an empty string is null."""
    trimmed = F.trim(raw)
    return F.when(trimmed != "", trimmed).try_cast(kind)


def decode_json(df: DataFrame, column: str, schema: T.StructType | str, mode: str = "nested", ignore_errors: bool = True, fail_on_missing: bool = False, keep: list[str] = ()) -> DataFrame:
    """Columns of the schema from a JSON column (text or UTF-8 bytes).

    nested: malformed JSON is an error unless ignored; numbers may be written as strings; unknown fields are skipped.
    flat: every top-level value is read alone, so one that doesn't fit is null and the others stay; a text
    that isn't an object gives nulls only.
    strict: Spark's own reader, which fails at the first text that doesn't fit unless errors are ignored.
    """
    kind = _kind(schema)
    text = F.col(column).cast("string")
    options = {"mode": "PERMISSIVE" if ignore_errors else "FAILFAST"}
    if mode == "strict":
        raw = F.from_json(text, kind, options)
        columns = [raw[f.name].alias(f.name) for f in kind.fields]
    elif mode in ("nested", "flat"):
        simple = lambda t: isinstance(t, (T.NumericType, T.StringType)) or mode == "flat"
        loose = T.StructType([T.StructField(f.name, T.StringType() if simple(f.dataType) else f.dataType) for f in kind.fields])
        raw = F.from_json(text, loose, options if mode == "nested" else {"mode": "PERMISSIVE"})
        columns = []
        for f in kind.fields:
            value = raw[f.name]
            if isinstance(f.dataType, T.NumericType):
                value = _number_or_text(value, f.dataType)
            elif simple(f.dataType) and not isinstance(f.dataType, T.StringType):
                value = value.try_cast(f.dataType)
            columns.append(value.alias(f.name))
    else:
        raise ValueError(f"no mode {mode!r}")
    decoded = df.select(*keep, *columns)
    if fail_on_missing:
        checks = [F.when(F.get_json_object(text, f"$.{f.name}").isNull() & ~F.coalesce(F.array_contains(F.json_object_keys(text), f.name), F.lit(False)), F.raise_error(F.lit(f"{f.name} is missing"))).otherwise(F.lit(0)) for f in kind.fields]
        decoded = df.where(F.least(*checks, F.lit(0)) == 0).select(*keep, *columns)
    return decoded


def json_view(df: DataFrame, column: str, schema: str, name: str, proctime: str | None = "proctime", **options) -> DataFrame:
    """Decode a column of JSON bytes, add the time of processing, and register a view of the result."""
    if not isinstance(df.schema[column].dataType, (T.BinaryType, T.StringType)):
        raise TypeError("the column must hold bytes or text")
    out = decode_json(df, column, schema, **options)
    out = out.withColumn(proctime, F.current_timestamp()) if proctime else out
    out.createOrReplaceTempView(name)
    return out


def encode_json(df: DataFrame, keep_nulls: bool = True, out: str = "value") -> DataFrame:
    """One column of JSON objects."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": str(not keep_nulls).lower()}).alias(out))


def decode_csv(df: DataFrame, column: str, schema: T.StructType | str, delimiter: str = ",", ignore_errors: bool = True) -> DataFrame:
    """Columns of the schema from lines; with errors ignored a field that doesn't fit is null, else it fails the job."""
    kind = _kind(schema)
    raw = F.from_csv(F.col(column), kind.simpleString()[7:-1].replace(":", " "), {"sep": delimiter, "mode": "PERMISSIVE" if ignore_errors else "FAILFAST", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    return df.select(*[raw[f.name].alias(f.name) for f in kind.fields])


def encode_csv(df: DataFrame, delimiter: str = ",", out: str = "value") -> DataFrame:
    return df.select(F.to_csv(F.struct("*"), {"sep": delimiter}).alias(out))


def encode_raw(df: DataFrame, column: str, out: str = "value") -> DataFrame:
    """One column as it is."""
    return df.select(F.col(column).cast("string").alias(out))


def to_bytes(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("binary"))


#: The fields of the log message by tag; text unless said otherwise.
LOG_FIELDS = {1: "dt", 2: "bs", 3: "report_time", 4: "browser_uniq_id", 5: "os_plant", 6: "page_id", 7: "page_name", 8: "page_param", 9: "item_id", 10: "item_type", 11: "visit_time"}
LOG_NUMBERS = {9: "long", 10: "int"}


def message_class(fields: dict[int, str], numbers: dict[int, str] = {}, name: str = "LogData"):  # noqa: B006
    """A protobuf class with text, int and long fields, made from their tags."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    kinds = {"long": descriptor_pb2.FieldDescriptorProto.TYPE_INT64, "int": descriptor_pb2.FieldDescriptorProto.TYPE_INT32, "string": descriptor_pb2.FieldDescriptorProto.TYPE_STRING}
    file = descriptor_pb2.FileDescriptorProto(name=f"{name.lower()}.proto", package="tidemill", syntax="proto3")
    message = file.message_type.add(name=name)
    for tag, field in fields.items():
        message.field.add(name=field, number=tag, type=kinds[numbers.get(tag, "string")], label=descriptor_pb2.FieldDescriptorProto.LABEL_OPTIONAL)
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(f"tidemill.{name}"))


def decode_protobuf(df: DataFrame, column: str, fields: dict[int, str] = LOG_FIELDS, numbers: dict[int, str] = LOG_NUMBERS) -> DataFrame:
    """Columns from protobuf messages, by Arrow batches; fields that aren't declared are skipped; bytes that are no message give nulls."""
    schema = ", ".join(f"{name} {numbers.get(tag, 'string')}" for tag, name in fields.items())
    types = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = message_class(fields, numbers)
        for batch in batches:
            rows = []
            for raw in batch.column(0).to_pylist():
                try:
                    m = kind.FromString(raw)
                    rows.append({name: getattr(m, name) for name in fields.values()})
                except Exception:  # noqa: BLE001  the parser's errors have no common class; null is no message either
                    rows.append({})
            yield pa.RecordBatch.from_pylist(rows, types)

    return df.select(column).mapInArrow(run, schema)


def encode_protobuf(df: DataFrame, fields: dict[int, str] = LOG_FIELDS, numbers: dict[int, str] = LOG_NUMBERS, out: str = "value") -> DataFrame:
    """Protobuf messages from rows; null fields are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = message_class(fields, numbers)
        for batch in batches:
            raw = [kind(**{k: v for k, v in r.items() if v is not None}).SerializeToString() for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pydict({out: pa.array(raw, pa.binary())})

    return df.select(*fields.values()).mapInArrow(run, f"{out} binary")
