"""A key-value table in files: upserts and deletions in batches, merged in levels.

A batch becomes a run of Parquet files on level 0, one row for each of its keys.
When a level has FANOUT runs they are merged into one of the next level, so
that n batches leave about FANOUT * log(n) runs, and a read touches no more.
Deletions stay as rows until they reach the deepest run (or for good where an
order guards rows, so that no older row comes back).  A manifest, one
small file for each version, names the runs that count and the least and
greatest first key of each; a reader keeps to the version it has read, and a
batch counts once its manifest is there, whole and only once.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Runs of a level that are merged, and versions whose files are kept for readers.
FANOUT, VERSIONS = 4, 3
_OWN = ("_gone", "_order", "_batch")


class KeyValueTable:
    """The table in a folder.

    keys: its key columns.  order: a column that guards rows; one replaces
    another of its key only if its order is no less (null is the least).
    Without it the later batch wins.  gone: a boolean column that tells
    deletions; a deletion is guarded likewise.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str | None = None, gone: str | None = None, fanout: int = FANOUT):
        self.spark, self.path, self.keys, self.order, self.gone, self.fanout = spark, path.rstrip("/"), list(keys), order, gone, fanout

    # ---- manifests ----

    def _fs(self, name: str) -> tuple[Any, Any]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def versions(self) -> list[int]:
        fs, place = self._fs("_manifest")
        if not fs.exists(place):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(place)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The runs of a version (the newest unless given), and the last batch in it."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "batch": -1, "runs": [], "schema": None}
        fs, place = self._fs(f"_manifest/{version:012d}.json")
        stream = fs.open(place)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        version = manifest["version"]
        fs, draft = self._fs(f"_manifest/.{version}-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        _, place = self._fs(f"_manifest/{version:012d}.json")
        if fs.exists(place) or not fs.rename(draft, place):
            raise RuntimeError(f"version {version} of {self.path} was written by someone else")
        self._clear(version - VERSIONS)

    def _clear(self, upto: int) -> None:
        """Older versions go, and the runs that no other has: theirs, and those of writes that failed."""
        kept = {r["name"] for v in self.versions() if v > upto for r in self.manifest(v)["runs"]}
        for v in self.versions():
            if v <= upto:
                fs, place = self._fs(f"_manifest/{v:012d}.json")
                fs.delete(place, False)
        fs, place = self._fs("")
        for status in fs.listStatus(place):
            if status.getPath().getName().startswith("run-") and status.getPath().getName() not in kept:
                fs.delete(status.getPath(), True)

    # ---- rows ----

    def _latest(self, rows: DataFrame) -> DataFrame:
        """One row a key: that of the largest order, of equal ones of the latest batch."""
        columns = [c for c in rows.columns if c not in self.keys]
        rank = F.struct(F.col("_order").isNotNull(), "_order", "_batch")
        best = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*columns), rank).alias("_r"))
        return best.select(*self.keys, *[F.col("_r")[c].alias(c) for c in columns])

    def _run(self, rows: DataFrame, level: int) -> dict:
        """Write a run; what the manifest has to know of it."""
        name = f"run-{uuid.uuid4().hex}"
        first = self.keys[0]
        rows.repartition(*[F.col(k) for k in self.keys]).sortWithinPartitions(*self.keys).write.parquet(f"{self.path}/{name}")
        text = F.col(first).cast("string")
        found = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}").agg(F.count(F.lit(1)).alias("n"), F.min(first).cast("string").alias("low"), F.max(first).cast("string").alias("high"), F.count_if(text.isNull()).alias("nulls")).first()
        return {"name": name, "level": level, "rows": found["n"], "low": found["low"], "high": found["high"], "nulls": found["nulls"]}

    def _read(self, runs: list[dict], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{r['name']}" for r in runs])

    def write(self, batch: DataFrame, number: int) -> bool:
        """Put a batch; tells whether it was new.  A number that is there already, or an older one, changes nothing."""
        now = self.manifest()
        if number <= now["batch"]:
            return False
        gone = F.coalesce(F.col(self.gone), F.lit(False)) if self.gone else F.lit(False)
        order = F.col(self.order) if self.order else F.lit(None).cast("long")
        kept = [c for c in batch.columns if c != self.gone]
        rows = batch.select(*kept, gone.alias("_gone"), order.alias("_order"), F.lit(number).cast("long").alias("_batch"))
        one = self._latest(rows).select(*kept, *_OWN)
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in one.schema])
        if now["schema"] is not None and T.StructType.fromJson(now["schema"]) != schema:
            raise ValueError("the batch has other columns than the table")
        runs = [*now["runs"], self._run(one, 0)]
        self._publish({"version": now["version"] + 1, "batch": number, "runs": self._merged(runs, schema), "schema": schema.jsonValue()})
        return True

    def _merged(self, runs: list[dict], schema: T.StructType) -> list[dict]:
        level = 0
        while level <= max(r["level"] for r in runs):
            own = [r for r in runs if r["level"] == level]
            if len(own) >= self.fanout:
                rest = [r for r in runs if r["level"] != level]
                rows = self._latest(self._read(own, schema)).select(*schema.names)
                if not self.order and not any(r["level"] > level for r in rest):  # nothing is left that a deletion could hide
                    rows = rows.where("not _gone")
                runs = [*rest, self._run(rows, level + 1)]
            level += 1
        return runs

    def _may_hold(self, run: dict, low: Any, high: Any, kind: T.DataType) -> bool:
        """Whether a run can have first keys from low to high; both are as the column's values, None for no bound."""
        if run["low"] is None:
            return False
        as_value = float if isinstance(kind, T.DoubleType) else int if isinstance(kind, T.NumericType) else str
        return not (low is not None and as_value(run["high"]) < as_value(low) or high is not None and as_value(run["low"]) > as_value(high))

    def read(self, low: Any = None, high: Any = None, version: int | None = None) -> DataFrame:
        """The current rows, or those whose first key is from low to high: runs that can't hold any are not opened."""
        now = self.manifest(version)
        if now["schema"] is None:
            raise ValueError(f"there is no table in {self.path}")
        schema = T.StructType.fromJson(now["schema"])
        kind, bounded = schema[self.keys[0]].dataType, low is not None or high is not None
        can_prune = isinstance(kind, (T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DoubleType))
        runs = [r for r in now["runs"] if not (bounded and can_prune) or self._may_hold(r, low, high, kind)]
        rows = self._read(runs, schema) if runs else self.spark.createDataFrame([], schema)
        key = F.col(self.keys[0])
        bounds: list[Column] = [*([key >= F.lit(low)] if low is not None else []), *([key <= F.lit(high)] if high is not None else [])]
        for b in bounds:
            rows = rows.where(b)
        return self._latest(rows).where("not _gone").select(*[c for c in schema.names if c not in _OWN])
