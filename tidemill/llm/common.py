"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many rows of two numbers are broadcast.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the session names none and runs on one machine, as in tests, a
    temporary folder is made once and kept in the session; on a cluster that
    is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidemill.shared.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("tidemill.shared.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and reread it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def done_with(*tables: DataFrame) -> None:
    """Remove tables that `written` has made; nothing that is still to be computed may read them."""
    for df in tables:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Within it, Python workers are sent at most so many rows at a time: rows that hold texts or sets are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Memory that the driver's Python no longer uses goes back to the system: unreachable objects, Arrow's pool, the allocator's free lists."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc can
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow whose worker gives memory back at the end of a task: workers live on, and their next task is another stage's."""

    def inner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def maybe_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    """A broadcast hint if the counted rows are within the bound; else a shuffle join."""
    return F.broadcast(df) if rows <= most else df


def held_out(doc_id: Column | str) -> Column:
    """The rows that no label is learnt from: crc32(doc_id as text) mod 4 is 2."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 4 == 2


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small constant table, made by the JVM from one JSON literal."""
    one = spark.range(1, numPartitions=1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r"))
    return one.select("r.*")


def text_key(text: Column | str = "text") -> Column:
    """A hash of a text; with the doc_id it tells rows apart, but for rows that repeat both.  Null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("string"))


def _keyed(docs: DataFrame, keys: DataFrame, rows: int, how: str) -> DataFrame:
    """docs semi- or anti-joined with (doc_id, fp) under names of their own, so that no column of docs can clash."""
    own = uuid.uuid4().hex
    right = keys.select(F.col("doc_id").alias(f"i{own}"), F.col("fp").alias(f"f{own}"))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(f"i{own}")) & (text_key(docs["text"]) == F.col(f"f{own}"))
    return docs.join(maybe_broadcast(right, rows, BROADCAST_ROWS), same, how)


def without(docs: DataFrame, gone: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """docs less the rows named by gone; of rows named by repeated, which are equal in doc_id and text, one of each is left.

    gone, repeated: doc_id and fp (text_key); null ids are equal.  All columns of docs stay.
    """
    gone = written(gone.select("doc_id", "fp").distinct(), "gone")
    kept = _keyed(docs, gone, gone.count(), "left_anti")
    if repeated is None:
        return kept
    repeated = written(repeated.select("doc_id", "fp").distinct(), "repeated")
    n = repeated.count()
    if not n:
        return kept
    own = f"t{uuid.uuid4().hex}"
    one = _keyed(kept, repeated, n, "left_semi").withColumn(own, text_key()).dropDuplicates(["doc_id", own]).drop(own)
    return _keyed(kept, repeated, n, "left_anti").unionByName(one)
