"""Document sinks: bulk requests, and updates guarded by an order."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row

from tidemill.sinks.batching import Writer


def guarded_script(columns: list[str], order: list[tuple[str, bool]], id_column: str = "") -> dict[str, str]:
    """An update script that takes effect only if one of the order columns moves on (up if ascending), or has no value yet."""
    fields = [c for c in columns if c != id_column]
    if missing := [c for c, _ in order if c not in fields]:
        raise ValueError(f"no such columns: {missing}")
    tests = [f"ctx._source.{c} == null || ctx._source.{c} {'<' if asc else '>'} params.{c}" for c, asc in order]
    updates = " ".join(f"ctx._source.{c} = params.{c};" for c in fields)
    return {"lang": "painless", "source": f"if({' || '.join(tests)}){{{updates}}}"}


def plain(value):
    """Rows, arrays and maps as JSON values."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value if isinstance(value, (str, int, float, bool, type(None))) else str(value)


def bulk_lines(row: Row, index: str, id_column: str | None, operation: str = "index", script: dict | None = None, ignore_nulls: bool = False) -> list[str]:
    """The lines of one row in a bulk request."""
    body = {k: v for k, v in plain(row).items() if k != id_column and not (ignore_nulls and v is None)}
    action = {"_index": index} | ({"_id": row[id_column]} if id_column else {})
    if operation in ("index", "create"):
        return [json.dumps({operation: action}), json.dumps(body)]
    if operation not in ("update", "upsert"):
        raise ValueError(f"no operation {operation!r}")
    change = {"script": script | {"params": body}} if script else {"doc": body}
    if operation == "upsert":
        change |= {"upsert": body} if script else {"doc_as_upsert": True}
    return [json.dumps({"update": action}), json.dumps(change)]


def document_writer(send: Callable[[], Callable[[str], None]], index: str, id_column: str | None, operation: str = "index", script: dict | None = None, batch_size: int = 500, ignore_nulls: bool = False) -> Writer:
    """Write rows as bulk requests.  send is called once a partition and gives the function that posts a request's text."""

    def rows_of(rows: Iterator[Row]) -> None:
        post, rows = send(), iter(rows)
        while chunk := list(islice(rows, batch_size)):
            post("".join(f"{line}\n" for r in chunk for line in bulk_lines(r, index, id_column, operation, script, ignore_nulls)))

    def write(batch: DataFrame, number: int) -> None:
        batch.foreachPartition(rows_of)

    return write


def rest_sender(hosts: list[str], **auth) -> Callable[[], Callable[[str], None]]:
    """Posts to the bulk address of a cluster; an answer that tells of errors is one."""

    def start() -> Callable[[str], None]:
        from tidemill.sources.lookups import RestClient

        rest = RestClient(hosts, **auth)

        def post(text: str) -> None:
            answer = rest.call("_bulk", text.encode(), "application/x-ndjson") or {}
            if answer.get("errors"):
                raise RuntimeError(f"bulk request failed: {json.dumps(answer)[:500]}")

        return post

    return start


def cells_writer(put: Callable[[], Callable[[list[tuple[str, dict[str, bytes]]]], None]], row_key: str, family: str, batch_size: int = 500) -> Writer:
    """Write rows as cells (row key, {family:column: bytes}) of a wide-column store; null cells and rows without a key are left out."""

    def rows_of(rows: Iterator[Row]) -> None:
        send, rows = put(), iter(rows)
        while chunk := list(islice(rows, batch_size)):
            cells = [(str(r[row_key]), {f"{family}:{k}": v if isinstance(v, bytes) else str(v).encode() for k, v in r.asDict().items() if k != row_key and v is not None}) for r in chunk if r[row_key] is not None]
            send([c for c in cells if c[1]])

    def write(batch: DataFrame, number: int) -> None:
        batch.foreachPartition(rows_of)

    return write
