"""Sessions with the settings that the library counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Results depend on the time zone; state that outgrows memory needs the on-disk store.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(app: str = "tidemill", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the library's settings and, above those, the given ones (dots written as two underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Give a session that exists the settings that can still be changed."""
    for key, value in SETTINGS.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark
