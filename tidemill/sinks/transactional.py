"""Plain inserts into a database, each row once: a stream writer that commits by epoch.

Tasks insert their rows into a staging table, under a token of their own.
When all tasks of a batch are through, one transaction moves the rows of their
tokens to the target and notes the batch's number in a table of epochs beside
it.  A batch that is run again after a failure finds its number there and
only clears its staging rows; what failed or doubled tasks have staged is
never moved, and goes with the query's next commit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

from tidemill.sinks.databases import SIMPLE
from tidemill.util import retry

#: Types of the staging table, which holds what the target will.
SQL_TYPES = {T.StringType: "TEXT", T.IntegerType: "INTEGER", T.LongType: "BIGINT", T.FloatType: "REAL", T.DoubleType: "DOUBLE PRECISION"}


@dataclass
class Staged(WriterCommitMessage):
    token: str
    rows: int


@dataclass
class Target:
    """Where rows go.  connect: makes a DB-API connection, on executors and the driver."""

    connect: Callable[[], Any]
    table: str
    columns: list[str]
    kinds: list[str]
    query: str
    epochs: str = "tidemill_epochs"
    batch_size: int = 500
    tries: int = 3
    placeholder: str = "?"

    @property
    def staging(self) -> str:
        return f"{self.table}_staged"

    def sql(self, text: str) -> str:
        return text.replace("?", self.placeholder)

    def prepare(self) -> None:
        """Make the staging and epoch tables where they aren't there."""
        columns = ", ".join(f"{c} {k}" for c, k in zip(self.columns, self.kinds))
        self.run([(f"CREATE TABLE IF NOT EXISTS {self.staging} (tm_query VARCHAR(200), tm_token VARCHAR(36), {columns})", ()), (f"CREATE TABLE IF NOT EXISTS {self.epochs} (query VARCHAR(200) PRIMARY KEY, epoch BIGINT)", ())])

    def run(self, statements: list[tuple[str, tuple]]) -> None:
        """Statements in one transaction."""
        connection = self.connect()
        try:
            cursor = connection.cursor()
            for text, values in statements:
                cursor.execute(self.sql(text), values)
            connection.commit()
        finally:
            connection.close()

    def stage(self, rows: Iterator, token: str) -> int:
        connection, n = self.connect(), 0
        insert = self.sql(f"INSERT INTO {self.staging} (tm_query, tm_token, {', '.join(self.columns)}) VALUES ({', '.join('?' * (len(self.columns) + 2))})")
        try:
            cursor = connection.cursor()
            rows = iter(rows)
            while chunk := [(self.query, token, *(r[c] for c in self.columns)) for r in islice(rows, self.batch_size)]:
                cursor.executemany(insert, chunk)
                connection.commit()  # chunk by chunk: other tasks wait for no long transaction
                n += len(chunk)
        finally:
            connection.close()
        return n

    def commit(self, epoch: int, tokens: list[str]) -> bool:
        """Move the rows of the tokens, unless the epoch is there already; tells whether it did."""
        connection = self.connect()
        try:
            cursor = connection.cursor()
            # Taking hold of the query's row first keeps two drivers apart.
            cursor.execute(self.sql(f"UPDATE {self.epochs} SET epoch = epoch WHERE query = ?"), (self.query,))
            cursor.execute(self.sql(f"SELECT epoch FROM {self.epochs} WHERE query = ?"), (self.query,))
            found = cursor.fetchone()
            new = found is None or found[0] < epoch
            if new:
                names = ", ".join(self.columns)
                for token in tokens:
                    cursor.execute(self.sql(f"INSERT INTO {self.table} ({names}) SELECT {names} FROM {self.staging} WHERE tm_query = ? AND tm_token = ?"), (self.query, token))
                cursor.execute(self.sql(f"INSERT INTO {self.epochs} (epoch, query) VALUES (?, ?)" if found is None else f"UPDATE {self.epochs} SET epoch = ? WHERE query = ?"), (epoch, self.query))
            cursor.execute(self.sql(f"DELETE FROM {self.staging} WHERE tm_query = ?"), (self.query,))
            connection.commit()
            return new
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()


class _EpochWriter(DataSourceStreamWriter):
    def __init__(self, target: Target):
        self.target = target

    def write(self, iterator: Iterator) -> Staged:
        token = uuid.uuid4().hex
        return Staged(token, self.target.stage(iterator, token))

    def commit(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803  name of the interface
        tokens = [m.token for m in messages if m is not None and m.rows]
        retry(lambda: self.target.commit(batchId, tokens), self.target.tries, 0.2)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        self.target.run([(f"DELETE FROM {self.target.staging} WHERE tm_query = ? AND tm_token = ?", (self.target.query, m.token)) for m in messages if m is not None])


def epoch_sink(stream: DataFrame, connect: Callable[[], Any], table: str, checkpoint: str, query: str | None = None, once: bool = False, interval: str = "1 second", mode: str = "append", **options: Any) -> StreamingQuery:
    """Insert a stream's rows into a table of a database, each row once, though batches are run again.

    connect makes a DB-API connection; it is sent to the executors.  query
    names the stream in the table of epochs (the table's name if none is
    given); it goes with the checkpoint: a new checkpoint needs a new name, as
    its batches are numbered anew.  options: epochs, batch_size, tries, placeholder.
    """
    if bad := [f.name for f in stream.schema if not isinstance(f.dataType, SIMPLE)]:
        raise TypeError(f"columns of unsupported types: {bad}")
    target = Target(connect, table, stream.columns, [SQL_TYPES[type(f.dataType)] for f in stream.schema], query or table, **options)
    target.prepare()
    source = f"tidemill_epochs_{uuid.uuid4().hex}"

    class EpochSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return source

        def streamWriter(self, schema: T.StructType, overwrite: bool) -> _EpochWriter:  # noqa: N802
            return _EpochWriter(target)

    stream.sparkSession.dataSource.register(EpochSource)
    writer = stream.writeStream.format(source).option("checkpointLocation", checkpoint).outputMode(mode)
    return writer.trigger(**({"availableNow": True} if once else {"processingTime": interval})).start()
