"""File sinks: lines, partitioned ORC, key-value tables as files, and compaction."""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemill.sinks.batching import Writer
from tidemill.sinks.keyvalue import KeyValueTable
from tidemill.sources.formats import encode_csv, encode_json

log = logging.getLogger("tidemill.rows")


def encode_lines(df: DataFrame, kind: str = "json", delimiter: str = ",") -> DataFrame:
    if kind not in ("json", "csv"):
        raise ValueError(f"no format {kind!r}")
    return encode_json(df) if kind == "json" else encode_csv(df, delimiter)


def lines_writer(path: str, kind: str = "json", delimiter: str = ",") -> Writer:
    """Append rows as lines to files of a folder."""

    def write(batch: DataFrame, number: int) -> None:
        encode_lines(batch, kind, delimiter).write.mode("append").text(path)

    return write


def exactly_once_files(stream: DataFrame, path: str, checkpoint: str, fmt: str = "json", partition_by: list[str] = (), once: bool = False, interval: str = "1 minute", **options: str) -> StreamingQuery:
    """A stream's rows in files of which a reader sees those of committed batches only, each once."""
    writer = stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.outputMode("append").trigger(**({"availableNow": True} if once else {"processingTime": interval})).start()


def write_orc(df: DataFrame, path: str, partition_by: list[str] = (), compression: str = "snappy", mode: str = "append") -> None:
    """ORC files, by folders of the partition columns; a _SUCCESS file is left when all is written."""
    rows = df.repartition(*partition_by) if partition_by else df
    writer = rows.write.mode(mode).option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).orc(path)


def compact(spark: SparkSession, source: str, target: str, fmt: str = "orc", file_bytes: int = 128 << 20) -> int:
    """Rewrite many small files as files of about file_bytes; gives their number."""
    df = spark.read.format(fmt).load(source)
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    total = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    files = max(1, math.ceil(total / file_bytes))
    df.coalesce(files).write.mode("errorifexists").format(fmt).save(target)
    return files


def kv_writer(path: str, keys: list[str], spark: SparkSession, order: str | None = None, gone: str | None = None) -> Writer:
    """Keep a table of the latest row by key (see KeyValueTable); read_kv gives its current rows."""

    def write(batch: DataFrame, number: int) -> None:
        KeyValueTable(spark, path, keys, order, gone).write(batch, number)

    return write


def read_kv(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The current row of each key."""
    return KeyValueTable(spark, path, keys).read()


def _say(level: str, line: str) -> None:
    if level == "print":
        print(line, flush=True)
    else:
        getattr(log, "warning" if level == "warn" else level)(line)


def log_writer(level: str = "info", prefix: str = "", encode: Callable[[DataFrame], DataFrame] = encode_json, say: Callable[[str, str], None] = _say) -> Writer:
    """Log every row as JSON, where it is: each executor logs its own partitions."""
    if level not in ("error", "warn", "info", "debug", "print"):
        raise ValueError(f"no level {level!r}")

    def write_rows(rows: Iterator) -> None:
        for r in rows:
            say(level, f"{prefix}{r[0]}")

    def write(batch: DataFrame, number: int) -> None:
        encode(batch).foreachPartition(write_rows)

    return write
