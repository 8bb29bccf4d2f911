"""Lookups in outside stores by key: pluggable clients, kept per worker, with a cache of what was found."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import uuid
from base64 import b64encode
from collections import OrderedDict
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema


class FoundCache:
    """The latest values found, up to so many and for so long; misses are not kept."""

    def __init__(self, max_rows: int = 10_000, ttl_seconds: float = 600, clock: Callable[[], float] = time.monotonic):
        self.max_rows, self.ttl, self.clock = max_rows, ttl_seconds, clock
        self.held: OrderedDict[Any, tuple[float, dict]] = OrderedDict()

    def held_now(self, key: Any) -> dict | None:
        held = self.held.get(key)
        if held and self.clock() - held[0] < self.ttl:
            self.held.move_to_end(key)
            return held[1]
        return None

    def put(self, key: Any, found: dict | None) -> None:
        self.held.pop(key, None)
        if found is not None and self.max_rows:
            self.held[key] = (self.clock(), found)
            while len(self.held) > self.max_rows > 0:
                self.held.popitem(last=False)

    def get(self, key: Any, find: Callable[[Any], dict | None]) -> dict | None:
        if (held := self.held_now(key)) is not None:
            return held
        found = find(key)
        self.put(key, found)
        return found


class Many:
    """A client that finds many keys with one request: many gives a dict of those found."""

    def __init__(self, many: Callable[[list], dict[Any, dict]]):
        self.many = many

    def __call__(self, key: Any) -> dict | None:
        return self.many([key]).get(key)


#: Of a worker: client and cache of the lookups it has served lately, so that its later tasks go on with them.
_SERVED: OrderedDict[str, tuple[Callable[[Any], dict | None], FoundCache]] = OrderedDict()
SERVED = 8


def _served(token: str, client: Callable[[], Callable[[Any], dict | None]], max_rows: int, ttl_seconds: float) -> tuple[Callable[[Any], dict | None], FoundCache]:
    if token not in _SERVED:
        _SERVED[token] = (client(), FoundCache(max_rows, ttl_seconds))
        while len(_SERVED) > SERVED:
            _SERVED.popitem(last=False)
    _SERVED.move_to_end(token)
    return _SERVED[token]


def find_all(keys: list, find: Callable[[Any], dict | None], cache: FoundCache, batch_size: int, pool: ThreadPoolExecutor | None) -> dict[Any, dict | None]:
    """What each distinct key finds: from the cache, or asked for, batch_size of them in a request where the client can."""
    out = {k: cache.held_now(k) for k in dict.fromkeys(keys) if k is not None}
    open_ = [k for k, found in out.items() if found is None]
    if isinstance(find, Many):
        parts = [open_[i : i + batch_size] for i in range(0, len(open_), batch_size)]
        answers = pool.map(find.many, parts) if pool and len(parts) > 1 else map(find.many, parts)
        found = {k: row for answer in answers for k, row in answer.items()}
    else:
        found = {k: find(k) for k in open_}
    for k in open_:
        out[k] = found.get(k)
        cache.put(k, out[k])
    return out


def kv_lookup(left: DataFrame, key: str, client: Callable[[], Callable[[Any], dict | None]], columns: str, prefix: str = "", max_rows: int = 10_000, ttl_seconds: float = 600, inner: bool = False, batch_size: int = 500, in_flight: int = 4) -> DataFrame:
    """Add columns found by key in an outside store; nulls (or no row, if inner) where nothing is found.

    client is called once in every worker and gives a function from a key to a
    row or None, or Many: then the distinct keys of a batch that the worker's
    cache has not are asked for batch_size at a time, in_flight requests at once.
    Null keys are not looked up.  left may be a stream.
    """
    if batch_size < 1 or in_flight < 1:
        raise ValueError("batch_size and in_flight must be positive")
    from tidemill.sources.ddl import parse_schema, to_text

    kind = parse_schema(columns)
    names = [f"{prefix}{n}" for n in kind.names]
    schema = f"{to_text(left.schema)}, {', '.join(f'{prefix}{f.name} {f.dataType.simpleString()}' for f in kind.fields)}"

    types = to_arrow_schema(kind)

    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, cache = _served(token, client, max_rows, ttl_seconds)
        with ThreadPoolExecutor(in_flight) if isinstance(find, Many) and in_flight > 1 else nullcontext() as pool:
            for batch in batches:
                keys = batch.column(key).to_pylist()
                known = find_all(keys, find, cache, batch_size, pool)
                found = [known.get(k) for k in keys]
                extra = [pa.array([(r or {}).get(f.name) for r in found], f.type) for f in types]
                out = pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *names])
                yield out.filter(pa.array([r is not None for r in found], pa.bool_())) if inner else out

    return left.mapInArrow(run, schema)


class KeyedDimension:
    """A dimension in an outside store, looked up by its first column; batches or streams are joined with it."""

    def __init__(self, columns: str, client: Callable[[], Callable[[Any], dict | None]], max_rows: int = 10_000, ttl_seconds: float = 600):
        self.columns, self.client, self.max_rows, self.ttl = columns, client, max_rows, ttl_seconds

    def join(self, left: DataFrame, on: dict[str, str], how: str = "left") -> DataFrame:
        """on: a column of left to the dimension's key.  Columns that left has too get the prefix dim_."""
        from tidemill.sources.ddl import parse_schema

        kind = parse_schema(self.columns)
        if list(on.values()) != [kind.names[0]] or how not in ("left", "inner"):
            raise ValueError(f"a left or inner join on {kind.names[0]!r} is all that a lookup by key can do")
        found = kv_lookup(left, next(iter(on)), self.client, self.columns, "_found_", self.max_rows, self.ttl, inner=how == "inner")
        return found.withColumnsRenamed({f"_found_{n}": f"dim_{n}" if n in left.columns else n for n in kind.names})


#: Clients that tables of connector `reflect` may name: a function from the table's options to a client.  Nothing else is ever loaded.
CLIENTS: dict[str, Callable[[dict[str, str]], Callable[[], Callable[[Any], dict | None]]]] = {}


def named_client(name: str):
    """Allow a client under a name, as a decorator."""

    def keep(make):
        CLIENTS[name] = make
        return make

    return keep


@named_client("documents")
def _documents(options: dict[str, str]) -> Callable[[], Callable[[str], dict | None]]:
    auth = {"user": options["es.net.http.auth.user"], "password": options.get("es.net.http.auth.pass")} if "es.net.http.auth.user" in options else {}
    return document_client([h.strip() for h in options["es.nodes"].split(",")], options["es.resource"], **auth)


def cells_client(connect: Callable[[], Callable[[str], dict[str, bytes] | None]], columns: str, family: str = "cf", fields: str = "") -> Callable[[], Callable[[str], dict | None]]:
    """A client over a store of cells: connect gives a function from a row key to its cells (family:qualifier to bytes).

    fields maps columns to cells (`a:cf:x,b:cf:y`); others are family:column.  Cells hold text, which is cast to the column's type.
    """
    from tidemill.sources.ddl import parse_schema

    kind = parse_schema(columns)
    of = {n: f"{family}:{n}" for n in kind.names[1:]} | dict(x.strip().split(":", 1) for x in fields.split(",") if x.strip())
    casts = {"int": int, "bigint": int, "smallint": int, "tinyint": int, "double": float, "float": float, "boolean": lambda t: t.lower() == "true"}

    def start() -> Callable[[str], dict | None]:
        get = connect()

        def find(key: str) -> dict | None:
            cells = get(key)
            if cells is None:
                return None
            out: dict = {kind.names[0]: key}
            for f in kind.fields[1:]:
                raw = cells.get(of[f.name])
                out[f.name] = None if raw is None else raw if f.dataType.simpleString() == "binary" else casts.get(f.dataType.simpleString(), str)(raw.decode())
            return out

        return find

    return start


class RestClient:
    """GET and POST of JSON, going on to the next host after a failure."""

    def __init__(self, hosts: list[str], user: str | None = None, password: str | None = None, tries: int = 2, timeout: float = 10.0, opener: Callable = urllib.request.urlopen):
        if not hosts:
            raise ValueError("no hosts are given")
        self.hosts, self.tries, self.timeout, self.opener, self.at = hosts, tries, timeout, opener, 0
        self.headers = {"Content-Type": "application/json"}
        if user is not None:
            self.headers["Authorization"] = "Basic " + b64encode(f"{user}:{password or ''}".encode()).decode()

    def call(self, path: str, body: bytes | None = None, content_type: str | None = None) -> dict | None:
        """The answer, or None if there is nothing at the path."""
        error: Exception | None = None
        for _ in range(self.tries):
            request = urllib.request.Request(f"{self.hosts[self.at].rstrip('/')}/{path.lstrip('/')}", data=body, headers=self.headers | ({"Content-Type": content_type} if content_type else {}))
            try:
                with self.opener(request, timeout=self.timeout) as answer:
                    return json.loads(answer.read())
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    return None
                error = e
            except OSError as e:
                error = e
            self.at = (self.at + 1) % len(self.hosts)
        raise error  # type: ignore[misc]


def document_client(hosts: list[str], index: str, **auth) -> Callable[[], Callable[[str], dict | None]]:
    """A client for kv_lookup that gets documents of an index by id, many with one request."""

    def start() -> Many:
        rest = RestClient(hosts, **auth)

        def many(keys: list) -> dict[Any, dict]:
            ids = {str(k): k for k in keys}
            answer = rest.call(f"{index}/_mget", json.dumps({"ids": list(ids)}).encode(), "application/json") or {}
            return {ids[d["_id"]]: d["_source"] for d in answer.get("docs", []) if d.get("found") and d.get("_id") in ids}

        return Many(many)

    return start
