"""Tables declared by a schema and options, read and written by their connector."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators.joins import RefreshedDimension
from tidemill.sources import faker, formats
from tidemill.sources.ddl import parse_schema, to_text
from tidemill.sources.lookups import CLIENTS, KeyedDimension, cells_client
from tidemill.sources.replay import START, lines_from, replay_lines


@dataclass
class Table:
    """A declared table: its columns, options, computed columns (name to SQL) and watermark (column, delay)."""

    schema: T.StructType
    options: dict[str, str]
    computed: dict[str, str] = field(default_factory=dict)
    watermark: tuple[str, str] | None = None

    def need(self, key: str) -> str:
        if key not in self.options:
            raise ValueError(f"option {key!r} is missing")
        return self.options[key]

    def finish(self, df: DataFrame) -> DataFrame:
        for name, sql in self.computed.items():
            df = df.withColumn(name, F.expr(sql))
        return df.withWatermark(*self.watermark) if self.watermark and df.isStreaming else df


def decode_lines(df: DataFrame, table: Table) -> DataFrame:
    """Rows from a text column `value`, by the table's format."""
    kind = table.options.get("format", "json")
    if kind == "raw":
        return df.select(F.col("value").alias(table.schema.names[0]))
    ignore = lambda f: table.options.get(f"{f}.ignore-parse-errors", "false") == "true"
    if kind == "csv":
        return formats.decode_csv(df, "value", table.schema, table.options.get("csv.field-delimiter", ","), ignore("csv"))
    modes = {"json": "strict", "myjson": "nested", "myjsonjava": "flat"}
    if kind not in modes:
        raise ValueError(f"no format {kind!r}")
    return formats.decode_json(df, "value", table.schema, modes[kind], ignore(kind) or kind == "myjsonjava", table.options.get(f"{kind}.fail-on-missing-field", "false") == "true")


def read_files(spark: SparkSession, table: Table) -> DataFrame:
    """Files with the declared columns only; columnar formats are pruned by name without regard to case, or by place for _colN files."""
    kind, path = table.options.get("format", "json"), table.need("path")
    if kind in ("orc", "parquet"):
        found = spark.read.format(kind).load(path)
        if all(c.startswith("_col") for c in found.columns):
            return found.select(*[F.col(found.columns[i]).cast(f.dataType).alias(f.name) for i, f in enumerate(table.schema.fields)])
        return spark.read.format(kind).schema(table.schema).load(path).select(*table.schema.names)
    return decode_lines(spark.read.text(path), table)


def read_lines(spark: SparkSession, table: Table) -> DataFrame:
    """A text file's lines, cycle-num times over (once unless given), up to number-of-rows-subtask rows."""
    lines = spark.read.text(table.need("path"))
    cycles = int(table.options.get("cycle-num", "1"))
    if cycles > 1:
        lines = lines.select("value", F.explode(F.sequence(F.lit(1), F.lit(cycles))).alias("_c")).drop("_c")
    rows = decode_lines(lines, table)
    limit = int(table.options.get("number-of-rows-subtask", "-1"))
    return rows if limit < 0 else rows.limit(limit)


def stream_lines(spark: SparkSession, table: Table) -> DataFrame:
    """A text file's lines one after the other, over and over: one each source.sleep (10 ms), for cycle-num cycles or number-of-rows-subtask rows if given."""
    path, sleep = table.need("path"), float(table.options.get("source.sleep", "10 ms").split()[0])
    if not any(True for _ in lines_from(path, dict(START), 1, 1)):
        raise ValueError("there is no line to replay")
    number = lambda k: int(table.options[k]) if k in table.options else None
    return decode_lines(replay_lines(spark, path, 1000 / max(sleep, 0.01), number("cycle-num"), number("number-of-rows-subtask")), table)


def stream_files(spark: SparkSession, table: Table) -> DataFrame:
    return decode_lines(spark.readStream.option("maxFilesPerTrigger", table.options.get("files-per-trigger", "1")).text(table.need("path")), table)


def stream_socket(spark: SparkSession, table: Table) -> DataFrame:
    """Lines of a TCP connection, trimmed, without blank ones."""
    lines = spark.readStream.format("socket").option("host", table.need("hostname")).option("port", table.need("port")).load()
    return decode_lines(lines.select(F.trim("value").alias("value")).where("value <> ''"), table)


def stream_kafka(spark: SparkSession, table: Table) -> DataFrame:
    """Values of a topic; needs Spark's connector package on the class path."""
    starts = {"earliest-offset": "earliest", "latest-offset": "latest", "group-offsets": "latest"}
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", table.need("properties.bootstrap.servers")).option("subscribe", table.need("topic"))
    reader = reader.option("startingOffsets", starts.get(table.options.get("scan.startup.mode", "group-offsets"), "latest")).option("kafka.group.id", table.options.get("properties.group.id", "tidemill"))
    return decode_lines(reader.load().select(F.col("value").cast("string").alias("value")), table)


def read_jdbc(spark: SparkSession, table: Table) -> DataFrame:
    reader = spark.read.format("jdbc").option("url", table.need("url")).option("dbtable", table.need("table-name"))
    for key in ("username", "password", "driver"):
        if key in table.options:
            reader = reader.option("user" if key == "username" else key, table.options[key])
    return reader.load().select(*table.schema.names)


BATCH: dict[str, Callable[[SparkSession, Table], DataFrame]] = {
    "filesystem": read_files,
    "myfilesystem": read_files,
    "mylocalfile": read_lines,
    "faker": lambda spark, t: faker.fake(spark, t.schema, t.options, int(t.options.get("seed", "0"))),
    "datagen": lambda spark, t: faker.datagen(spark, t.schema, t.options, int(t.options.get("number-of-rows", "1000"))),
    "jdbc": read_jdbc,
}
BATCH["java-faker"] = BATCH["faker"]
STREAM: dict[str, Callable[[SparkSession, Table], DataFrame]] = {
    "filesystem": stream_files,
    "mylocalfile": stream_lines,
    "mysocket": stream_socket,
    "java-mysocket": stream_socket,
    "kafka": stream_kafka,
    "faker": lambda spark, t: faker.fake_stream(spark, t.schema, t.options, int(t.options.get("seed", "0"))),
}
STREAM["java-faker"] = STREAM["faker"]


class Tables:
    """The declared tables of a session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self._dims = spark, {}, {}

    def declare(self, name: str, schema: str | T.StructType, options: dict[str, str], computed: dict[str, str] | None = None, watermark: tuple[str, str] | None = None) -> Table:
        kind = parse_schema(schema) if isinstance(schema, str) else schema
        if "connector" not in options:
            raise ValueError("option 'connector' is missing")
        self.tables[name] = Table(kind, dict(options), computed or {}, watermark)
        return self.tables[name]

    def read(self, name: str, view: bool = True) -> DataFrame:
        """The table as it is now; registered as a view of its name, for SQL."""
        return self._open(name, BATCH, view)

    def stream(self, name: str, view: bool = True) -> DataFrame:
        return self._open(name, STREAM, view)

    def _open(self, name: str, readers: dict, view: bool) -> DataFrame:
        table = self.tables[name]
        connector = table.options["connector"]
        if connector not in readers:
            raise ValueError(f"connector {connector!r} can't be read {'as a stream' if readers is STREAM else 'at once'}")
        df = table.finish(readers[connector](self.spark, table))
        if view:
            df.createOrReplaceTempView(name)
        return df

    def dimension(self, name: str, connect: Callable | None = None) -> RefreshedDimension | KeyedDimension:
        """The table as a dimension, reloaded by lookup.cache.ttl (seconds; an hour unless given) and limited by lookup.cache.max-rows.

        Tables of key-value stores (myes, myhbase, reflect) are looked up by
        key instead, with those options for what was found.  connect: for
        myes a client for kv_lookup, in place of one over HTTP; for myhbase a
        function from a row key to cells, made in every task.
        """
        table = self.tables[name]
        if table.options["connector"] in ("myes", "myhbase", "reflect"):
            if name not in self._dims:
                self._dims[name] = self._keyed(table, connect)
            return self._dims[name]
        if name not in self._dims:
            options = self.tables[name].options
            self._dims[name] = RefreshedDimension(lambda: self.read(name, view=False), float(options.get("lookup.cache.ttl", "3600")), int(options.get("lookup.cache.max-rows", "100000")))
        return self._dims[name]

    @staticmethod
    def _keyed(table: Table, connect: Callable | None) -> KeyedDimension:
        options, columns = table.options, to_text(table.schema)
        if options["connector"] == "myes":
            client = connect or CLIENTS["documents"](options)
        elif options["connector"] == "myhbase":
            if connect is None:
                raise ValueError("a function that connects to the store is needed")
            client = cells_client(connect, columns, options.get("cf", "cf"), options.get("fields", ""))
        else:
            if table.need("client") not in CLIENTS:
                raise ValueError(f"no client {options['client']!r} is allowed")
            client = CLIENTS[options["client"]](options)
        return KeyedDimension(columns, client, int(options.get("lookup.cache.max-rows", "10000")), float(options.get("lookup.cache.ttl", "600")))

    def insert(self, name: str, df: DataFrame, **streaming: str):
        """Write df to the table by its connector; a stream is started and its query given back."""
        from tidemill.sinks.tables import write_table

        return write_table(self.tables[name], df, **streaming)

    def insert_all(self, name: str, parts: list[DataFrame]):
        return self.insert(name, reduce(DataFrame.unionByName, parts))
