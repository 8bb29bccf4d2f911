import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from tidemill.operators import windows
from tidemill.streaming import stateful
from tidemill.streaming.windows import changes, collect_stream, current_watermark, encode_changes, replay, upserts_only


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def running(stream, name, checkpoint, mode="update"):
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).start()


def until(spark, name, ready, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        rows = spark.table(name).collect()
        if ready(rows):
            return rows
        time.sleep(0.3)
    return spark.table(name).collect()


def test_event_time_tumble_drops_late_rows(spark, folder):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    schema = "name string, ts timestamp"
    path = f"{folder}/in"
    for rows in ([("a", at(1)), ("a", at(3)), ("b", at(80))], [("a", at(2)), ("b", at(81))], [("z", at(300))]):
        put(spark, path, rows, schema)
    out = windows.tumble(replay(spark, path, spark.read.parquet(path).schema), "ts", "5 seconds", ["name"], "5 seconds", n=F.count(F.lit(1)))
    query = collect_stream(out, "tumbled", f"{folder}/check")
    query.awaitTermination()
    got = {(r.name, r.window_start): r.n for r in spark.table("tumbled").collect()}
    assert got[("b", at(80))] == 2 and ("z", at(300)) not in got
    assert current_watermark(query)


def test_group_updates(spark, folder):
    path = f"{folder}/in"
    put(spark, path, [("a",), ("b",)], "k string")
    put(spark, path, [("a",)], "k string")
    counts = replay(spark, path, "k string").groupBy("k").count()
    collect_stream(counts, "updates", f"{folder}/check", "update").awaitTermination()
    assert max(r["count"] for r in spark.table("updates").where("k = 'a'").collect()) == 2


def test_wait_join_emits_complete_then_partial(spark, folder):
    schemas = {"one": "id int, name string, seq long", "two": "id int, age int, seq long"}
    for side, s in schemas.items():
        spark.createDataFrame([], s).write.parquet(f"{folder}/{side}")
    put(spark, f"{folder}/one", [(1, "a", 1), (2, "b", 2), (1, "c", 3)], schemas["one"])
    put(spark, f"{folder}/two", [(1, 30, 4)], schemas["two"])
    sides = {side: replay(spark, f"{folder}/{side}", s, files_per_trigger=100) for side, s in schemas.items()}
    out = stateful.wait_join(sides, "id", delay_ms=1500, seq="seq")
    query = running(out, "joined", f"{folder}/check")
    try:
        rows = until(spark, "joined", lambda rows: any(r.id == 1 for r in rows))
        full = [r for r in rows if r.id == 1 and r.two]
        assert json.loads(full[-1].one)["name"] == "c" and json.loads(full[-1].two)["age"] == 30
        rows = until(spark, "joined", lambda rows: any(r.id == 2 for r in rows))
        assert [(json.loads(r.one)["name"], r.two) for r in rows if r.id == 2] == [("b", None)]
        put(spark, f"{folder}/two", [(2, 40, 5)], schemas["two"])
        rows = until(spark, "joined", lambda rows: any(r.id == 2 and r.two for r in rows))
        assert [json.loads(r.two)["age"] for r in rows if r.id == 2 and r.two] == [40]
    finally:
        query.stop()


def test_gates():
    assert stateful.always({}, {}) == (True, True)
    assert stateful.unless_equal({"a": 1}, {"a": 1}) == (False, False) and stateful.unless_equal({"a": 2}, {"a": 1}) == (True, True)


@pytest.mark.parametrize("eager", [True, False])
def test_throttle(spark, folder, eager):
    path, schema = f"{folder}/in", "id int, v int, seq long"
    put(spark, path, [(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 9, 4)], schema)
    name = f"throttled_{eager}"
    query = running(stateful.throttle(replay(spark, path, schema), "id", 1500, eager, seq="seq"), name, f"{folder}/check")
    try:
        done = lambda rows: {json.loads(r.row)["v"] for r in rows} >= ({1, 3, 9} if eager else {3, 9})
        values = [json.loads(r.row)["v"] for r in until(spark, name, done) if r.id == 1]
        assert values == ([1, 3] if eager else [3])
    finally:
        query.stop()


def test_history(spark, folder):
    path = f"{folder}/in"
    put(spark, path, [("a", "x")], "k string, v string")
    put(spark, path, [("a", "y")], "k string, v string")
    out = stateful.history(replay(spark, path, "k string, v string"), "k", "v", 600_000)
    query = running(out, "histories", f"{folder}/check")
    try:
        rows = until(spark, "histories", lambda rows: any(r.n == 2 for r in rows))
        assert max((sorted(r.history) for r in rows), key=len) == ["x", "y"]
    finally:
        query.stop()


def test_rolling_stream_matches_the_batch(spark, folder):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    path, schema = f"{folder}/in", "name string, code int, tm timestamp"
    rows = [("j", c, at(s)) for c, s in [(1, 1), (2, 2), (2, 12), (5, 12), (3, 30)]]
    put(spark, path, rows[:2], schema)
    put(spark, path, rows[2:], schema)
    put(spark, path, [("end", 0, at(500))], schema)
    put(spark, path, [("j", 99, at(3)), ("end", 0, at(501))], schema)  # late
    kinds = {"n": ("count", "*"), "n_distinct": ("count_distinct", "code"), "max_value": ("max", "code"), "codes": ("collect", "code"), "listed": ("listagg", "code"), "total": ("sum", "code")}
    out = stateful.rolling_stream(replay(spark, path, spark.read.parquet(path).schema), "name", "tm", 10, kinds)
    collect_stream(out, "rolled", f"{folder}/check").awaitTermination()
    last = next(r for r in spark.table("rolled").collect() if r.n == 3)
    assert sorted(last.codes) == [2, 2, 5] and sorted(last.listed.split(",")) == ["2", "2", "5"] and last.total == 9
    got = sorted((r.time_ms, r.n, r.n_distinct, r.max_value) for r in spark.table("rolled").collect() if r.name == "j")
    base = int(dt.datetime(2024, 1, 1, tzinfo=dt.UTC).timestamp() * 1000)
    assert got == [(base + 1000, 1, 1, 1), (base + 2000, 2, 2, 2), (base + 12000, 3, 2, 5), (base + 12000, 3, 2, 5), (base + 30000, 1, 1, 3)]
    with pytest.raises(ValueError):
        stateful.rolling_stream(spark.range(1), "id", None, 1, {"x": ("median", "id")})


def test_rolling_stream_on_processing_time(spark, folder):
    path, schema = f"{folder}/in", "name string, code long"
    put(spark, path, [("j", 2**53 + 1), ("k", 1)], schema)
    put(spark, path, [("j", 2), ("j", None)], schema)
    out = stateful.rolling_stream(replay(spark, path, schema), "name", None, 3600, {"n": ("count", "*"), "codes": ("collect_distinct", "code"), "low": ("min", "code")})
    query = running(out, "rolled_now", f"{folder}/check")
    try:
        rows = until(spark, "rolled_now", lambda rows: len(rows) >= 4)
        got = sorted((r.name, r.n, sorted(r.codes), r.low) for r in rows)
        assert got == [("j", 1, [2**53 + 1], 2**53 + 1), *[("j", 3, [2, 2**53 + 1], 2)] * 2, ("k", 1, [1], 1)]
    finally:
        query.stop()


def test_changes_have_both_halves(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (5, None)], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (4, "d"), (5, None)], "id int, v string")
    log = changes(old, new, ["id"])
    assert sorted((r.op, r.id, r.v) for r in log.collect()) == [("+I", 4, "d"), ("+U", 2, "c"), ("-D", 3, None), ("-U", 2, "b")]
    assert sorted(r.value for r in encode_changes(log, upserts=True).collect()) == ['{"id":2,"v":"c"}', '{"id":4,"v":"d"}']
    assert '{"op":"-U","id":2,"v":"b"}' in {r.value for r in encode_changes(log).collect()}


def test_upserts_only(spark):
    df = spark.createDataFrame([("+I", 1), ("-U", 1), ("+U", 2), ("-D", 2)], "op string, v int")
    assert [r.v for r in upserts_only(df).collect()] == [1, 2]


def test_processing_time_tumble(spark, folder):
    path = f"{folder}/in"
    put(spark, path, [("a",), ("a",), ("b",)], "k string")
    out = windows.tumble_processing_time(replay(spark, path, "k string"), "1 hour", ["k"], n=F.count(F.lit(1)))
    collect_stream(out, "proc", f"{folder}/check", "update").awaitTermination()
    assert {r.k: r.n for r in spark.table("proc").collect()} == {"a": 2, "b": 1}
