"""Writing to declared tables by their connector."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemill.operators.ordering import parse_order
from tidemill.sinks import databases, documents, files, queues
from tidemill.sinks.batching import KeyedMode, Writer, batching_sink


def writer_of(table, connect=None) -> Writer:
    """The writer of a declared table."""
    options, kind = table.options, table.options["connector"]
    if kind in ("mylocalfile", "filesystem") and options.get("format", "json") in ("json", "csv"):
        return files.lines_writer(table.need("path"), options.get("format", "json"), options.get("csv.field-delimiter", ","))
    if kind == "filesystem":
        parts = [c.strip() for c in options.get("partition-by", "").split(",") if c.strip()]
        return lambda batch, _: files.write_orc(batch, table.need("path"), parts)
    if kind in ("mylog", "print"):
        return files.log_writer("print" if kind == "print" else options.get("log-level", "info"), "" if options.get("sink.insert-only", "true") == "true" else "+U ")
    if kind in ("myjdbc", "jdbc"):
        if connect is None:
            raise ValueError("a function that connects to the database is needed")
        old = [c.strip() for c in options.get("old-val-columns", "").split(",") if c.strip()]
        keys = [c.strip() for c in options.get("keys", "").split(",") if c.strip()]
        return databases.database_writer(connect, table.need("table-name"), table.schema, options.get("update-mode", "false") == "true", old, keys, options.get("dialect", "mysql"), int(options.get("sink.batch.size", "500")))
    if kind == "myes":
        order = options.get("update-script-orderby")
        id_column = options.get("es.mapping.id")
        script = documents.guarded_script(table.schema.names, parse_order(order), id_column or "") if order else None
        sender = connect or documents.rest_sender([h.strip() for h in table.need("es.nodes").split(",")])
        return documents.document_writer(sender, table.need("es.resource"), id_column, options.get("es.write.operation", "index"), script)
    if kind == "myhbase":
        return documents.cells_writer(connect, table.need("row-key"), options.get("cf", "cf"))
    if kind == "kafka":
        properties = {k.removeprefix("properties."): v for k, v in options.items() if k.startswith("properties.")}
        return queues.queue_writer(table.need("topic"), properties, options.get("format", "json"), options.get("csv.field-delimiter", ","), options.get("key.fields"), connect or "kafka")
    raise ValueError(f"connector {kind!r} can't be written")


def write_table(table, df: DataFrame, checkpoint: str | None = None, once: bool = False, connect=None, mode: str | None = None):
    """Write a batch at once, or start a query for a stream; rows are reduced by key where the options ask for it."""
    write, keyed = writer_of(table, connect), KeyedMode.from_options(table.options)
    if not df.isStreaming:
        write(keyed.reduce(df) if keyed else df, 0)
        return None
    if not checkpoint:
        raise ValueError("a stream needs a checkpoint folder")
    return batching_sink(df, write, checkpoint, table.options.get("sink.batch.interval", "1 second"), keyed, once=once, mode=mode)
