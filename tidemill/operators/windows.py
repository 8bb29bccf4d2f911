"""Rolling frames, rows chosen per key, and tumbling windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemill.operators.ordering import parse_order


def over_range(keys: list[str], time: str, seconds: float) -> WindowSpec:
    """Rows of the same keys from so many seconds before a row's time up to it; rows of the same time share a frame."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    return Window.partitionBy(*keys).orderBy(micros).rangeBetween(-int(seconds * 1_000_000), Window.currentRow)


def rolling(df: DataFrame, keys: list[str], time: str, seconds: float, **aggregates: Column) -> DataFrame:
    """df with aggregates over the rolling frame."""
    frame = over_range(keys, time, seconds)
    return df.select("*", *[a.over(frame).alias(n) for n, a in aggregates.items()])


def keyed_top1(df: DataFrame, keys: list[str], order: str, arrival: str | None = None) -> DataFrame:
    """One row per key: the largest in the order 'a asc, b desc' (nulls are smallest); of equals the one that arrived last.

    As a row replaces another if it is not less, 'a asc' keeps the largest a and 'a desc' the least.
    Rows are reduced by their keys before they are shuffled, so a hot key is no burden.
    """
    columns = [c for c in df.columns]
    signs = parse_order(order)
    if all(asc for _, asc in signs):
        rank = F.struct(*[F.struct(F.col(c).isNotNull().alias("known"), F.col(c).alias("value")).alias(f"o{i}") for i, (c, _) in enumerate(signs)], *([F.col(arrival).alias("arrival")] if arrival else []))
        best = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), rank).alias("_row"))
        return best.select("_row.*")
    by = [F.col(c).desc_nulls_last() if asc else F.col(c).asc_nulls_first() for c, asc in signs]
    if arrival:
        by.append(F.col(arrival).desc())
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_r = 1").drop("_r")


def tumble(df: DataFrame, time: str, length: str, keys: list[str] = (), watermark: str | None = None, **aggregates: Column) -> DataFrame:
    """window_start, window_end, the keys and aggregates of tumbling windows, for batches and streams.

    With a watermark ('5 seconds') rows later than that are dropped in a stream.
    """
    if watermark and df.isStreaming:
        df = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, watermark)
    grouped = df.groupBy(F.window(time, length).alias("_w"), *keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    return grouped.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, *aggregates)


def tumble_processing_time(df: DataFrame, length: str, keys: list[str] = (), **aggregates: Column) -> DataFrame:
    """Tumbling windows over the time of processing; a stream gives a window's rows once a later batch has come."""
    timed = df.withColumn("proctime", F.current_timestamp())
    return tumble(timed, "proctime", length, keys, "0 seconds", **aggregates)


def hop(df: DataFrame, time: str, length: str, slide: str, keys: list[str] = (), **aggregates: Column) -> DataFrame:
    """Sliding windows."""
    grouped = df.groupBy(F.window(time, length, slide).alias("_w"), *keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    return grouped.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, *aggregates)


def session_windows(df: DataFrame, time: str, gap: str, keys: list[str], **aggregates: Column) -> DataFrame:
    """Windows that end when a key has no row for the gap."""
    grouped = df.groupBy(F.session_window(time, gap).alias("_w"), *keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    return grouped.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, *aggregates)


def newest_per_interval(df: DataFrame, keys: list[str], time: str, interval: str) -> DataFrame:
    """The newest row of each key in each interval of a fixed grid: the batch form of lazy throttling."""
    cols = df.columns
    grid = df.groupBy(F.window(time, interval).alias("_w"), *keys).agg(F.max_by(F.struct(*cols), F.struct(time, *[c for c in cols if c != time])).alias("_row"))
    return grid.select(F.col("_w.start").alias("interval_start"), "_row.*")
