"""Running a batch table as a stream, and changelog views of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def replay(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int = 1) -> DataFrame:
    """The files of a folder as a stream, so many in each batch."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def collect_stream(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run over all that is there, into an in-memory table of that name."""
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_watermark(query: StreamingQuery) -> str | None:
    """The watermark after the last batch."""
    progress = query.lastProgress
    return (progress.get("eventTime") or {}).get("watermark") if progress else None


def changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """What turns one table into the other, as a change log: op, and the columns.

    +I and -D are rows of new and gone keys; an update has both its halves,
    the old row as -U and the new one as +U.  Rows that stay as they are leave nothing.
    """
    columns = after.columns
    old = before.select(*keys, F.struct(*columns).alias("_old"))
    new = after.select(*keys, F.struct(*columns).alias("_new"))
    both = old.join(new, keys, "full").where(~F.col("_old").eqNullSafe(F.col("_new")))
    half = lambda op, row: F.struct(F.lit(op).alias("op"), row.alias("row"))
    gone, came = F.col("_old"), F.col("_new")
    ops = F.when(gone.isNull(), F.array(half("+I", came))).when(came.isNull(), F.array(half("-D", gone))).otherwise(F.array(half("-U", gone), half("+U", came)))
    return both.select(F.inline(ops)).select("op", "row.*")


def encode_changes(log: DataFrame, op: str = "op", upserts: bool = False) -> DataFrame:
    """A change log as JSON text with its op column, or only the rows that add or replace, without it."""
    rows = upserts_only(log, op) if upserts else log
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def upserts_only(changes: DataFrame, op: str = "op") -> DataFrame:
    """Of a change log with an op column (+I, -U, +U, -D), the rows that add or replace."""
    return changes.where(f"{op} in ('+I', '+U')").drop(op)
