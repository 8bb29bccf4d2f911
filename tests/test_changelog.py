import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemill.streaming import changelog
from tidemill.streaming.windows import collect_stream, encode_changes, replay


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_exact_sums_forget_what_is_taken_back():
    rng = random.Random(1)
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 12) for _ in range(300)]
    s = changelog.ExactSum()
    for v in values:
        s.add(v)
    assert s.value() == math.fsum(values)
    for v in values[50:]:
        s = changelog.ExactSum(s.partials, s.strange)
        s.add(v, -1)
    assert s.value() == math.fsum(values[:50])
    for v in [*values[:50]]:
        s.add(v, -1)
    assert s.partials == [] and s.value() == 0
    for v in (math.nan, math.inf, -math.inf):
        s.add(v)
    assert math.isnan(s.value())
    s.add(math.nan, -1)
    s.add(-math.inf, -1)
    assert s.value() == math.inf


AGGREGATES = {"n": ("count", "*"), "held": ("count", "v"), "total": ("sum", "v"), "mean": ("avg", "v"), "low": ("min", "v"), "high": ("max", "v"), "kinds": ("count_distinct", "s"), "weight": ("sum", "w")}


def test_each_batch_gives_the_change_of_its_groups(spark, folder):
    path, schema = f"{folder}/in", "op string, g string, v double, s string, w long"
    put(spark, path, [("+I", "a", 1.5, "x", 1), ("+I", "a", None, None, None), ("+I", "b", 2.0, "x", 2**62)], schema)
    put(spark, path, [("-U", "a", 1.5, "x", 1), ("+U", "a", 4.0, "y", 5), ("+I", "c", 1.0, "z", 1)], schema)
    put(spark, path, [("-D", "b", 2.0, "x", 2**62), ("+I", "c", 1.0, "z", 0), ("-D", "c", 1.0, "z", 0)], schema)
    put(spark, path, [("-D", "a", None, None, None), ("-D", "a", 4.0, "y", 5), ("+I", "b", 0.1, "q", 3)], schema)
    log = changelog.group_changes(replay(spark, path, schema), ["g"], AGGREGATES, op="op")
    assert [f.name for f in log.schema] == ["op", "g", *AGGREGATES]
    collect_stream(log, "group_log", f"{folder}/check").awaitTermination()
    rows = [tuple(r) for r in spark.table("group_log").collect()]
    a1, a2 = ("a", 2, 1, 1.5, 1.5, 1.5, 1.5, 1, 1), ("a", 2, 1, 4.0, 4.0, 4.0, 4.0, 1, 5)
    b1, b2, c1 = ("b", 1, 1, 2.0, 2.0, 2.0, 2.0, 1, 2**62), ("b", 1, 1, 0.1, 0.1, 0.1, 0.1, 1, 3), ("c", 1, 1, 1.0, 1.0, 1.0, 1.0, 1, 1)
    assert rows[:2] in ([("+I", *a1), ("+I", *b1)], [("+I", *b1), ("+I", *a1)])
    # What comes and goes within a batch leaves nothing, and of an update both halves stand side by side.
    assert [r for r in rows if r[1] == "a"] == [("+I", *a1), ("-U", *a1), ("+U", *a2), ("-D", *a2)]
    assert [r for r in rows if r[1] == "b"] == [("+I", *b1), ("-D", *b1), ("+I", *b2)]
    assert [r for r in rows if r[1] == "c"] == [("+I", *c1)]
    left = changelog.replayed(spark.table("group_log"))
    assert sorted(tuple(r) for r in left.collect()) == [b2, c1]
    assert json.loads(encode_changes(spark.table("group_log"), upserts=True).where("value like '%\"a\"%'").collect()[-1].value)["total"] == 4.0


def test_updates_without_their_first_half_and_several_keys(spark, folder):
    path, schema = f"{folder}/in", "g string, h int, v int"
    put(spark, path, [("a", 1, 3), (None, 1, 3), ("a", 2, 4)], schema)
    put(spark, path, [("a", 1, 5), (None, 1, None)], schema)
    log = changelog.group_changes(replay(spark, path, schema), ["g", "h"], {"high": ("max", "v"), "total": ("sum", "v")}, update_before=False)
    collect_stream(log, "upserts", f"{folder}/check").awaitTermination()
    rows = [tuple(r) for r in spark.table("upserts").collect()]
    assert sorted(rows[:3], key=str) == sorted([("+I", "a", 1, 3, 3), ("+I", None, 1, 3, 3), ("+I", "a", 2, 4, 4)], key=str)
    assert rows[3:] == [("+U", "a", 1, 5, 8)]


def test_latest_rows_and_an_aggregate_over_them(spark, folder):
    path, schema = f"{folder}/in", "id int, at int, status string"
    put(spark, path, [(1, 1, "open"), (2, 1, "open"), (3, 5, "done")], schema)
    put(spark, path, [(1, 2, "done"), (3, 4, "open"), (2, 1, "open")], schema)
    put(spark, path, [(2, 9, "done"), (1, None, "none")], schema)
    latest = changelog.latest_changes(replay(spark, path, schema), ["id"], ["at"])
    collect_stream(latest, "latest_log", f"{folder}/one").awaitTermination()
    assert sorted(tuple(r) for r in changelog.replayed(spark.table("latest_log")).collect()) == [(1, 2, "done"), (2, 9, "done"), (3, 5, "done")]
    assert {r.op for r in spark.table("latest_log").collect()} == {"+I", "-U", "+U"}
    log = changelog.group_changes(changelog.latest_changes(replay(spark, path, schema), ["id"], ["at"]), ["status"], {"n": ("count", "*"), "first": ("min", "at")}, op="op")
    collect_stream(log, "status_log", f"{folder}/two").awaitTermination()
    rows = [tuple(r) for r in spark.table("status_log").collect()]
    assert ("-D", "open", 1, 1) in rows
    assert [tuple(r) for r in changelog.replayed(spark.table("status_log")).collect()] == [("done", 3, 2)]


def test_a_restarted_log_goes_on(spark, folder):
    path, schema = f"{folder}/in", "g string, v int"
    start = lambda: changelog.group_changes(replay(spark, path, schema), ["g"], {"n": ("count", "*"), "high": ("max", "v")}).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()
    put(spark, path, [("a", 1), ("b", 2)], schema)
    start()
    put(spark, path, [("a", 7)], schema)
    start()
    log = spark.read.parquet(f"{folder}/out")
    assert sorted(tuple(r) for r in log.where("op = '-U'").collect()) == [("-U", "a", 1, 1)]
    assert sorted(tuple(r) for r in changelog.replayed(log).collect()) == [("a", 2, 7), ("b", 1, 2)]


def test_replayed_keeps_rows_that_were_added_twice(spark):
    log = spark.createDataFrame([("+I", 1), ("+I", 1), ("-D", 2), ("+I", 2), ("+I", 3), ("-U", 3), ("+U", None)], "op string, v int")
    assert sorted((r.v for r in changelog.replayed(log).collect()), key=str) == [1, 1, None]


@pytest.mark.parametrize("aggregates", [{"x": ("median", "v")}, {"x": ("sum", "s")}, {"x": ("max", "none")}])
def test_unknown_aggregates(spark, aggregates):
    with pytest.raises(ValueError):
        changelog.group_changes(spark.range(1).select(F.col("id").alias("v"), F.lit("a").alias("s")), ["v"], aggregates)
