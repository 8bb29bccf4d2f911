"""Upserts into databases through DB-API connections, made by the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemill.sinks.batching import Writer
from tidemill.util import retry

SIMPLE = (T.StringType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def insert_sql(table: str, columns: list[str], update: bool = False, keep_old: list[str] = (), keys: list[str] = (), dialect: str = "mysql") -> str:
    """An insert, or an upsert in which keep_old columns keep a value that isn't null."""
    if unknown := set(keep_old) - set(columns):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    base = f"INSERT INTO {table} ({','.join(columns)}) VALUES ({','.join('?' * len(columns))})"
    if not update:
        return base
    if dialect == "mysql":
        sets = ",".join(f"{c}=IFNULL({c},VALUES({c}))" if c in keep_old else f"{c}=VALUES({c})" for c in columns)
        return f"{base} ON DUPLICATE KEY UPDATE {sets}"
    if not keys:
        raise ValueError("keys must be named in this dialect")
    sets = ",".join(f"{c}=COALESCE({table}.{c},excluded.{c})" if c in keep_old else f"{c}=excluded.{c}" for c in columns if c not in keys)
    return f"{base} ON CONFLICT ({','.join(keys)}) DO " + (f"UPDATE SET {sets}" if sets else "NOTHING")


def database_writer(connect: Callable[[], Any], table: str, schema: T.StructType, update: bool = False, keep_old: list[str] = (), keys: list[str] = (), dialect: str = "mysql", batch_size: int = 500, tries: int = 3, placeholder: str = "?") -> Writer:
    """Write rows in batches, each in a transaction; a failed batch is tried again on a new connection."""
    if bad := [f.name for f in schema.fields if not isinstance(f.dataType, SIMPLE)]:
        raise TypeError(f"columns of unsupported types: {bad}")
    columns = schema.names
    sql = insert_sql(table, columns, update, keep_old, keys, dialect).replace("?", placeholder)

    def rows_of(rows: Iterator) -> None:
        held: list = []

        def send(chunk: list[tuple]) -> None:
            if not held:
                held.append(connect())
            try:
                cursor = held[0].cursor()
                cursor.executemany(sql, chunk)
                held[0].commit()
            except Exception:
                broken = held.pop()
                try:
                    broken.close()
                except Exception:  # noqa: BLE001  it may be gone already
                    pass
                raise

        rows = iter(rows)
        try:
            while chunk := [tuple(r[c] for c in columns) for r in islice(rows, batch_size)]:
                retry(lambda chunk=chunk: send(chunk), tries, 0.1)
        finally:
            if held:
                held[0].close()

    def write(batch: DataFrame, number: int) -> None:
        batch.select(*columns).foreachPartition(rows_of)

    return write


def statement_runner(connect: Callable[[], Any]) -> Callable[[list[str]], None]:
    """Runs statements on a connection of the driver; for periodic upkeep."""

    def run(statements: list[str]) -> None:
        connection = connect()
        try:
            for s in statements:
                connection.cursor().execute(s)
            connection.commit()
        finally:
            connection.close()

    return run
