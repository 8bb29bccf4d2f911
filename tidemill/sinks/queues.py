"""Sinks for message queues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.sinks.batching import Writer


def queue_writer(topic: str, properties: dict[str, str], kind: str = "json", delimiter: str = ",", key: str | None = None, source: str = "kafka") -> Writer:
    """Send each row as a message: its value as JSON, CSV or as it is (raw, one column), at least once.

    properties go to the producer; they need bootstrap.servers.  key: the
    column whose text is the message's key, which decides the partition.
    source is the name of the data source that writes; Spark's connector
    package must be on the class path for kafka.
    """
    if "bootstrap.servers" not in properties:
        raise ValueError("option 'properties.bootstrap.servers' is missing")
    if kind not in ("json", "csv", "raw"):
        raise ValueError(f"no format {kind!r}")

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.col(key).cast("string").alias("key") if key else F.lit(None).cast("string").alias("key"), F.struct("*").alias("row"))
        if kind == "json":
            value = F.to_json("row", {"ignoreNullFields": "false"})
        elif kind == "raw":
            value = F.col("row")[batch.columns[0]].cast("string")
        else:
            value = F.to_csv("row", {"sep": delimiter})
        out = rows.select("key", value.alias("value"), F.lit(topic).alias("topic"))
        out.write.format(source).mode("append").options(**{f"kafka.{k}": v for k, v in properties.items()}).option("topic", topic).save()

    return write
