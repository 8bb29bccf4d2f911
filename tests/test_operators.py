import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemill.operators import aggregates, batches, joins, windows
from tidemill.operators.ordering import parse_keys, parse_order
from tidemill.util import read_settings, retry


def test_value_count_and_sum_skip_nulls(spark):
    df = spark.createDataFrame([(1, "a", 1.5), (1, "a", None), (1, None, 2.0), (2, None, None)], "g int, k string, v double")
    assert {r.g: r.counts for r in aggregates.value_count(df, ["g"], "k").collect()} == {1: {"a": 2}, 2: {}}
    assert {r.g: r.sums for r in aggregates.value_sum(df, ["g"], "k", "v").collect()} == {1: {"a": 1.5}, 2: {}}
    assert dict(aggregates.value_sum(df.withColumn("v", F.lit(1)), ["g"], "k", "v").dtypes)["sums"] == "map<string,bigint>"
    assert dict(aggregates.value_count(df, ["g"], "k", wide=True).dtypes)["counts"] == "map<string,bigint>"


def test_listagg(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 0)], "x string, o int")
    assert df.agg(aggregates.listagg("x")).first()[0] == "a,b"
    assert df.agg(aggregates.listagg("x", "|", "o")).first()[0] == "b|a"


def test_keyed_top1_orders_nulls_and_ties(spark):
    rows = [("k", None, 1, 0), ("k", 5, 1, 1), ("k", 5, 2, 2), ("k", 3, 9, 3), ("n", None, None, 4)]
    df = spark.createDataFrame(rows, "key string, a int, b int, seq int")
    asc = {r.key: (r.a, r.b) for r in windows.keyed_top1(df, ["key"], "a asc", "seq").collect()}
    assert asc == {"k": (5, 2), "n": (None, None)}
    mixed = {r.key: (r.a, r.b) for r in windows.keyed_top1(df, ["key"], "a asc, b desc", "seq").collect()}
    assert mixed["k"] == (5, 1)
    down = {r.key: r.a for r in windows.keyed_top1(df, ["key"], "a desc", "seq").collect()}
    assert down["k"] is None  # null is the smallest


def test_order_text():
    assert parse_order("a, b desc ,c ASC") == [("a", True), ("b", False), ("c", True)]
    assert parse_keys("a, b") == ["a", "b"]
    for bad in ("", "a up", "a b c"):
        with pytest.raises(ValueError):
            parse_order(bad)


def test_rolling_peers_share_a_frame(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    df = spark.createDataFrame([("k", at(0), 1), ("k", at(10), 2), ("k", at(10), 3), ("k", at(21), 4)], "k string, ts timestamp, v int")
    out = windows.rolling(df, ["k"], "ts", 10, n=F.count(F.lit(1)), top=F.max("v"))
    assert sorted((r.v, r.n, r.top) for r in out.collect()) == [(1, 1, 1), (2, 3, 3), (3, 3, 3), (4, 1, 4)]


def test_lookup_join_fans_out_and_nulls(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    dim = spark.createDataFrame([(1, "a"), (1, "b"), (None, "n")], "id int, name string")
    got = sorted(((r.id, r.name) for r in joins.lookup_join(left, dim, {"id": "id"}).collect()), key=str)
    assert got == sorted([(1, "a"), (1, "b"), (2, None), (None, None)], key=str)
    assert (None, "n") in [(r.id, r.name) for r in joins.lookup_join(left, dim, {"id": "id"}, null_keys_match=True).collect()]
    plain = joins.lookup_join(left, dim, {"id": "id"}, broadcast_rows=1)
    assert plain.count() == 4


def test_refreshed_dimension(spark):
    now, loads = [0.0], []

    def read():
        loads.append(1)
        if len(loads) == 1:
            raise OSError("not yet")
        return spark.createDataFrame([(1, f"v{len(loads)}")], "id int, name string")

    dim = joins.RefreshedDimension(read, ttl_seconds=10, wait_seconds=0, clock=lambda: now[0])
    left = spark.createDataFrame([(1,)], "id int")
    assert dim.join(left, {"id": "id"}).first().name == "v2"
    assert dim.join(left, {"id": "id"}).first().name == "v2"
    now[0] = 11
    assert dim.join(left, {"id": "id"}).first().name == "v3"
    with pytest.raises(ValueError):
        joins.RefreshedDimension(lambda: spark.range(5), max_rows=4).frame()


def test_wait_join_batch_keeps_the_latest(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "z", 1)], "id int, name string, t int")
    b = spark.createDataFrame([(1, 30, 5), (3, 40, 1)], "id int, age int, t int")
    out = joins.wait_join_batch({"a": a, "b": b}, "id", ["t"])
    assert sorted(((r.id, r.a_name, r.b_age) for r in out.collect()), key=str) == [(1, "y", 30), (2, "z", None), (3, None, 40)]


def test_batches_and_async(spark):
    df = spark.range(10, numPartitions=1)
    sizes = batches.batch_flat_map(df, lambda rows: [{"n": len(rows)}], "n int", 4)
    assert [r.n for r in sizes.collect()] == [4, 4, 2]
    with pytest.raises(Exception, match="came back"):
        batches.batch_map(df, lambda rows: [], "id long").collect()
    doubled = batches.async_map(df, lambda r: [{"id": r["id"] * 2}], "id long", capacity=3, ordered=True)
    assert [r.id for r in doubled.collect()] == list(range(0, 20, 2))
    loose = batches.async_map(df, lambda r: [{"id": r["id"]}], "id long", capacity=3)
    assert sorted(r.id for r in loose.collect()) == list(range(10))

    def slow(r):
        import time

        time.sleep(0.5 if r["id"] == 3 else 0)
        return [{"id": r["id"]}]

    late = batches.async_map(df, slow, "id long", timeout=0.1, ordered=True, on_timeout=lambda r: [{"id": -1}])
    assert sorted(r.id for r in late.collect()) == [-1, 0, 1, 2, 4, 5, 6, 7, 8, 9]
    with pytest.raises(Exception, match="no result within"):
        batches.async_map(df, slow, "id long", timeout=0.1).collect()


def test_fail_after(spark):
    with pytest.raises(Exception, match="failed on purpose"):
        batches.batch_map(spark.range(10, numPartitions=1), batches.FailAfter(5), "id long", 2).collect()


def test_lateral_explode_keeps_nulls(spark):
    df = spark.sql("SELECT * FROM VALUES (1, array('a', 'b')), (2, null), (3, array()) AS t(i, w)")
    assert sorted((r.i, r.x or "") for r in joins.lateral_explode(df, F.col("w"), "x").collect()) == [(1, "a"), (1, "b"), (2, ""), (3, "")]


def test_retry_and_settings(tmp_path):
    calls = []

    def shaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    assert retry(shaky, 3, 0) == 7
    with pytest.raises(OSError):
        retry(lambda: (_ for _ in ()).throw(OSError()), 2, 0)
    (tmp_path / "a.yaml").write_text("# c\nslots: 4\nname: 'x'\n")
    assert read_settings(str(tmp_path / "a.yaml")) == {"slots": "4", "name": "x"}


def test_wide_dimensions_are_not_broadcast(spark):
    wide = spark.range(50).select("id", F.repeat(F.lit("x"), 1000).alias("text"))
    assert joins.small_enough(wide, 50) and not joins.small_enough(wide, 49) and not joins.small_enough(wide, 50, 10_000)
    assert joins.small_enough(wide.limit(0), 0)
